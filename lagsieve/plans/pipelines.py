"""End-to-end runs: the exact reference over all pairs, screen-then-certify, and the planted acceptance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import generators as G
from ..functions import kernels as K
from ..operators import admission as A
from ..operators import association
from ..operators import nulls as N
from ..operators import probe as P
from ..operators import screen as SC
from ..sources import panel as sources
from ..sources import sinks
from . import splits as S

MOST_CHANNELS, MOST_SANITY = 32, 10
LEAST_FORMAL_B, HEADROOM = 200, 5


def effective_B(tier: str, channels: int, B: int, q: float = A.Q) -> int:
    """Formal runs need enough surrogates that a step-up over a target's sources can reject at all."""
    return max(B, LEAST_FORMAL_B, math.ceil(HEADROOM * (channels - 1) / q)) if tier == "formal" else B


def channels_of(panel: DataFrame) -> int:
    return panel.select("ch").distinct().count()


def probe_of(config: Config, B: int, **more) -> P.Probe:
    return P.Probe(config.lookback, config.pred_len, config.alpha_grid, B, config.seed, config.null_method, **more)


def reference(panel: DataFrame, splits: S.Splits, config: Config, *, q: float = A.Q) -> DataFrame:
    """Every ordered pair certified: probe, FDR per target, stability over certification blocks, admission. One pass of fits serves all blocks."""
    n = channels_of(panel)
    if n > MOST_CHANNELS:
        raise SystemExit(f"the exact reference takes at most {MOST_CHANNELS} channels, not {n}; screen first")
    config = config.with_(B=effective_B(config.tier, n, config.B, q))
    blocks = S.cert_blocks(splits, max(1, config.stability_blocks))
    long = P.deltas(panel, P.pairs(panel), splits, probe_of(config, config.B), blocks)
    rows = P.summarized(long, config.B).persist()
    full = rows.where("block = -1").select(*P.EDGE)
    full = sinks.with_lineage(full, config)
    tested = A.benjamini_hochberg(full, q, per=("target",))
    stable = A.stability(tested, rows.where("block >= 0"), len(blocks))
    return A.admit(stable)


def run_reference(spark: SparkSession, config: Config, *, tier: str | None = None, output: str | None = None) -> tuple[DataFrame, dict]:
    """The exact reference on a configured dataset, with its table and summary written if `output` is named."""
    config = config.with_(tier=tier or config.tier)
    panel, splits = sources.load(spark, config)
    n = channels_of(panel)
    if config.tier == "sanity":
        return sanity(panel, splits, config)
    edges = reference(panel, splits, config)
    B = effective_B(config.tier, n, config.B)
    config = config.with_(B=B)
    if output:
        folder = f"{output}/{sinks.run_id(config)}"
        edges = spark.read.parquet(sinks.write_edges(edges, folder))
        print("\n".join(report(edges, {"tier": config.tier, "effective_B": B, "output": folder})))
    counts = edges.agg(F.count("*").alias("n_edges"), F.count_if("e_certified").alias("n_e_certified")).first().asDict()
    summary = counts | {"dataset": config.dataset, "pred_len": config.pred_len, "tier": config.tier, "effective_B": B, "N": n, "m": n - 1, "q": A.Q, "C": HEADROOM}
    if output:
        sinks.write_summary(spark, summary, f"{folder}/summary.json")
    return edges, summary


def sanity(panel: DataFrame, splits: S.Splits, config: Config) -> tuple[DataFrame, dict]:
    """All pairs without FDR and stability, for few channels; p-values summarised over the finite ones."""
    n = channels_of(panel)
    if n > MOST_SANITY:
        raise SystemExit(f"a sanity run takes at most {MOST_SANITY} channels, not {n}")
    edges = sinks.with_lineage(P.certify(panel, P.pairs(panel), splits, probe_of(config, config.B)), config).persist()
    p = F.when(P.is_finite(F.col("p_value")), F.col("p_value"))
    summary = edges.agg(F.count("*").alias("n_edges"), F.count_if("certified_candidate").alias("n_candidates"), F.min(p).alias("p_min"), F.median(p).alias("p_median"), F.max(p).alias("p_max")).first().asDict()
    return edges, summary


def screen_then_certify(panel: DataFrame, splits: S.Splits, config: Config, *, top: int = SC.TOP, most_targets: int | None = 5, B: int | None = None) -> dict[str, DataFrame]:
    """screen: ranked scores; pairwise and group: verdicts on each target's top sources, with the same surrogates; spearman: screen against delta."""
    B = B or min(config.B, 5)
    top = min(top, channels_of(panel) - 1)
    screened = SC.screen(panel, splits, config.lookback, config.pred_len, config.alpha_grid, top=top, most=most_targets).persist()
    passed = screened.where("passed_screen")
    # a target's group: at most `top` sources, in order of rank
    groups = passed.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("screen_rank", "source"))), lambda r: r["source"]).alias("group"))
    probe = probe_of(config, B)
    ranks = passed.select("target", "source", "s_screen", "screen_rank")
    pairwise = P.certify(panel, passed.select("target", "source"), splits, probe).join(ranks, ["target", "source"])
    group = P.certify(panel, passed.select("target", "source").join(groups, "target"), splits, probe).join(ranks, ["target", "source"]).join(groups, "target")
    group = group.withColumns({"group_id": F.concat(F.lit("target_"), "target", F.lit(f"_top{top}")), "group_size": F.size("group")}).drop("group")
    group = group.withColumnsRenamed({"alpha_own": "alpha_reduced", "alpha_joint": "alpha_full"})
    return {"screen": screened, "pairwise": pairwise, "group": group, "spearman": association.spearman(pairwise.withColumn("all", F.lit(1)), "s_screen", "delta_true", ("all",)).drop("all")}


def spearman_p(row) -> float:
    """The p-value of a row of `spearman`."""
    return K.spearman_p(row["rho"], row["n"])


PLANTED_FRACTION = 0.67


def planted(spark: SparkSession, *, B: int = 39, seed: int = 2026, alphas=(0.01, 0.1, 1.0, 10.0), least: float = PLANTED_FRACTION) -> DataFrame:
    """The planted panel through probe, global FDR, three forward chains, admission; with edge_type."""
    panel = G.panel(spark, G.planted(seed))
    full, chains = S.planted_splits()
    labels = spark.createDataFrame(list(G.PLANTED_EDGES), "target int, source int, edge_type string")
    edges = labels.select("target", "source")
    probe = P.Probe(6, 1, tuple(alphas), B, seed)
    whole = A.benjamini_hochberg(P.certify(panel, edges, full, probe), per=())
    parts = [P.certify(panel, edges, s, probe).withColumn("block", F.lit(i)) for i, s in enumerate(chains)]
    blocks = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return A.admit(A.stability(whole, blocks, len(chains), least)).join(F.broadcast(labels), ["target", "source"])


def planted_verdict(edges: DataFrame) -> dict[str, bool]:
    """Whether the strong edge is recovered, the unrelated one not passed, the decoy not certified."""
    row = {r["edge_type"]: r for r in edges.collect()}  # three rows
    return {"strong_recovered": row["strong"]["e_certified"], "zero_rejected": not row["zero"]["fdr_pass"], "decoy_rejected": not row["shared_period_decoy"]["e_certified"]}


RECOVERY_LABELS = ("TRUE", "NULL", "DECOY")
#: Fixed value: how far apart the seeds of two recovery edges are.
RECOVERY_STEP = 1_000_003
DECOY_LIMIT = 0.01


def recovery(spark: SparkSession, *, n: int = 360, B: int = 39, seed: int = 2026, alphas=(0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """The twelve labelled edges of the recovery panel certified, each by surrogates of its own seed; with edge_type and admitted_candidate."""
    values = G.recovery(seed, n)
    panel = G.panel(spark, values, [f"x{j}" for j in range(values.shape[1])])
    labels = spark.createDataFrame([(t, s, kind, seed + RECOVERY_STEP * i) for i, (t, s, kind) in enumerate(G.RECOVERY_EDGES)], "target int, source int, edge_type string, seed long")
    edges = P.certify(panel, labels.select("target", "source", "seed"), S.figure_splits(n), P.Probe(6, 1, tuple(alphas), B, seed))
    passed = F.col("certified_candidate") & P.is_finite(F.col("p_value")) & (F.col("p_value") <= 0.10)
    return edges.join(F.broadcast(labels), ["target", "source"]).withColumn("admitted_candidate", passed)


def recovery_summary(edges: DataFrame) -> DataFrame:
    """by_label of recovery's edges, with the decoys' mean gain in R2 and whether it is over the limit: then the instrument takes a common driver for value."""
    decoy = edges.where("edge_type = 'DECOY'").agg(F.avg("delta_true").alias("decoy_mean_delta"))
    return association.by_label(edges, list(RECOVERY_LABELS)).crossJoin(F.broadcast(decoy)).withColumn("decoy_failed", F.coalesce(F.col("decoy_mean_delta") > DECOY_LIMIT, F.lit(False)))  # one row


def calibration(spark: SparkSession, *, pairs: int = 45, n: int = 260, B: int = 79, seed: int = 1000) -> DataFrame:
    """Verdicts on unrelated pairs, each with a panel and a seed of its own: their p-values should spread evenly."""
    import numpy as np

    values = np.column_stack([G.null_pair(seed + k, n) for k in range(pairs)])
    panel = G.panel(spark, values, [f"x{j}" for j in range(2 * pairs)])
    edges = spark.createDataFrame([(2 * k, 2 * k + 1, seed + k) for k in range(pairs)], "target int, source int, seed long")
    splits = S.Splits(S.Range(0, 250), S.Range(120, 180), S.Range(250, n), S.Range(0, 250), S.Range(40, 120), S.Range(120, 180), S.Range(180, 250))
    return P.certify(panel, edges, splits, P.Probe(5, 1, (0.1, 1.0, 10.0, 100.0), B))


def report(edges: DataFrame, summary: dict) -> list[str]:
    """The lines that a run prints: an edge a line in order, then the summary."""
    rows = edges.select("target", "source", "delta_true", "aligned_gain", "p_value", "certified_candidate").orderBy("target", "source").collect()  # at most MOST_CHANNELS squared
    lines = [f"target={r['target']} source={r['source']} delta={r['delta_true']:.6g} aligned={r['aligned_gain']:.6g} p={r['p_value']:.6g} candidate={r['certified_candidate']}" for r in rows]
    return [*lines, "summary:", *(f"  {k}={v:.6g}" if isinstance(v, float) else f"  {k}={v}" for k, v in summary.items())]


def association_rows(panel: DataFrame, splits: S.Splits, config: Config, n: int) -> DataFrame:
    """Each ordered pair's verdict beside its coherence and cross-correlation."""
    edges = P.certify(panel, P.pairs(panel), splits, probe_of(config, config.B))
    c = association.coherence(panel, n)
    c = c.select(F.explode(F.array(F.struct(F.col("a").alias("target"), F.col("b").alias("source")), F.struct(F.col("b").alias("target"), F.col("a").alias("source")))).alias("e"), "coherence_mean", "coherence_peak")
    both = c.select("e.target", "e.source", "coherence_mean", "coherence_peak")
    x = association.xcorr_absmax(panel).select(F.col("a").alias("target"), F.col("b").alias("source"), F.col("xcorr").alias("xcorr_absmax"))
    return edges.join(both, ["target", "source"]).join(x, ["target", "source"])


def certify_pair(spark: SparkSession, values, target: int, source: int, splits: S.Splits, probe: P.Probe) -> DataFrame:
    """One edge of a matrix in one call."""
    panel = G.panel(spark, values, [f"x{j}" for j in range(values.shape[1])])
    return P.certify(panel, spark.createDataFrame([(target, source)], "target int, source int"), splits, probe)


def surrogate_cache(spark: SparkSession, path: str, panel: DataFrame, B: int, seed: int) -> dict[str, int]:
    """Hits and misses of the stored bank; the misses are made."""
    bank, missed = N.cached(spark, path, panel, B, seed)
    return {"hits": bank.count() - missed, "misses": missed}


def batch(spark: SparkSession, names: list[str], load, run) -> dict[str, str]:
    """Run many configs; one that fails doesn't stop the others."""
    out = {}
    for name in names:
        try:
            run(load(name))
            out[name] = "ok"
        except (Exception, SystemExit) as e:  # reported, as a batch should
            out[name] = f"failed: {e}"
    return out
