"""The certifier: what a source adds to a target out of sample, against surrogates of the source.

Tasks (target, source, slice of surrogates) are the distributed relation. Their
kernel emits long rows, one for each surrogate and block of certification rows;
b = -1 stands for the true source and block = -1 for all rows. All that follows
is Catalyst. Fits don't depend on the block, so blocks cost no fits. Tasks that
share a target lie together, and its own history is fitted once for them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans import splits as S
from .series import Shared

VARIANCE_EPS = SPARSE_EPS = 1e-12
LEAST_ROWS = 8
NAN = float("nan")
DELTAS = (
    "target int, source int, mode string, block int, b int, delta double, alpha double, alpha_own double, n_train_fit int, n_val_alpha int, n_cert int, "
    "var_y double, sst double, max_abs_x double, norm_x double"
)


@dataclass(frozen=True)
class Probe:
    lookback: int
    horizon: int
    alphas: tuple[float, ...]
    B: int
    seed: int = 0
    null_method: str = "phase"
    alpha_rule: str = "val_grid"
    slice: int = 50
    parallelism: int | None = None

    def __post_init__(self):
        if self.B <= 0:
            raise ValueError("B must be positive")
        if self.null_method not in ("phase", "row_perm", "shift"):
            raise ValueError(f"unknown null method: {self.null_method}")
        if self.parallelism is not None and self.parallelism < 1:
            raise ValueError("parallelism must be positive")


class Task:
    """Designs of one target on its three splits, and the deltas of source blocks put beside its own history."""

    def __init__(self, own: np.ndarray, splits: S.Splits, probe: Probe):
        self.probe = probe
        self.rows = [K.rows_of(r.start, r.end, probe.lookback, probe.horizon) for r in splits.roles().values()]
        self.y = [own[u] for u in self.rows]
        self.own = self.window(own)

    def window(self, z: np.ndarray) -> list[np.ndarray]:
        return [K.lagged(z, u, self.probe.lookback, self.probe.horizon) for u in self.rows]

    def predict(self, *blocks: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """(predictions of the certification rows, alpha) from the own history and the blocks beside it."""
        fit, val, cert = (np.column_stack(parts) for parts in zip(self.own, *blocks))
        path = K.ridge_path(fit, self.y[0], self.probe.alphas)
        alpha = K.choose_alpha(path, val, self.y[1], self.probe.alpha_rule)
        return path.predict(cert, alpha), alpha


def delta(y: np.ndarray, reduced: np.ndarray, full: np.ndarray) -> tuple[float, float]:
    """(gain in R2 of full over reduced, SST): both R2 against the mean of y; NaN if y hardly varies."""
    sst = float(((y - y.mean()) ** 2).sum())
    if not np.isfinite(sst) or sst <= VARIANCE_EPS:
        return NAN, sst
    return (1 - float(((y - full) ** 2).sum()) / sst) - (1 - float(((y - reduced) ** 2).sum()) / sst), sst


def surrogate_blocks(task: Task, probe: Probe, z: np.ndarray, block: list[np.ndarray], source: int, b: int, spectrum) -> list[np.ndarray]:
    if probe.null_method == "row_perm":
        return K.row_permute_design(block, probe.seed, b)
    if probe.null_method == "shift":
        return task.window(K.turned(z, b, probe.B, probe.horizon))
    return task.window(K.surrogate(z, source, b, probe.seed, spectrum))


def run_task(target: int, source: int, mode: str, own: np.ndarray, z: np.ndarray, others: list[np.ndarray], before: int, low: int, high: int, splits: S.Splits, probe: Probe, blocks: list[S.Splits], memory: dict):
    """Rows of DELTAS for surrogates [low, high), and for the true source if low is 0. others: the group's other series, `before` of them ranked before the source."""
    key = ("task", target)
    if key not in memory:
        memory.clear()
        memory[key] = Task(own, splits, probe)
    task: Task = memory[key]
    beside = [task.window(x) for x in others]
    if others or ("reduced", target) not in memory:
        reduced = task.predict(*beside)
        if not others:
            memory["reduced", target] = reduced
    else:
        reduced = memory["reduced", target]
    block = task.window(z)
    spectrum = np.fft.rfft(z)
    cert, u = task.y[2], task.rows[2]
    masks = [(-1, np.ones(len(u), bool))] + [(i, (u >= s.cert.start) & (u < s.cert.end)) for i, s in enumerate(blocks)]
    for b in ([-1] if low == 0 else []) + list(range(low, high)):
        x = block if b < 0 else surrogate_blocks(task, probe, z, block, source, b, spectrum)
        full, alpha = task.predict(*beside[:before], x, *beside[before:])
        for number, mask in masks:
            y, part = cert[mask], block[2][mask]
            d, sst = delta(y, reduced[0][mask], full[mask])
            yield (target, source, mode, number, b, d, alpha, reduced[1], len(task.y[0]), len(task.y[1]), len(y), float(np.var(y)), sst, float(np.abs(part).max()), float(np.linalg.norm(part)))


def pairs(panel: DataFrame) -> DataFrame:
    """Every ordered (target, source): the channels' own small relation with itself, less its diagonal."""
    ids = panel.select("ch").distinct()
    return ids.select(F.col("ch").alias("target")).join(ids.select(F.col("ch").alias("source")), F.col("target") != F.col("source"))


def deltas(panel: DataFrame, edges: DataFrame, splits: S.Splits, probe: Probe, blocks: list[S.Splits] | None = None) -> DataFrame:
    """Long rows (DELTAS) of every edge (target, source[, group]); with a group (sources in rank order), the source is probed beside the group's others; with a seed, an edge has that instead of the probe's.

    Only the tasks' keys are shuffled while the panel is small enough to be sent to the executors once.
    """
    shared = Shared(panel)
    spark = panel.sparkSession
    grouped = "group" in edges.columns
    seeded = "seed" in edges.columns
    tasks = edges.select("target", "source", *(["group"] if grouped else []), *(["seed"] if seeded else []), F.explode(F.sequence(F.lit(0), F.lit(probe.B - 1), F.lit(probe.slice))).alias("low"))
    tasks = shared.join(shared.join(tasks, "target", "zt"), "source", "zs")
    if grouped:
        tasks = tasks.withColumn("before", F.array_position("group", F.col("source")) - 1)
    if grouped and shared.sent is None:
        others = edges.select("target", "source", F.posexplode("group").alias("place", "other")).where("other <> source")
        others = shared.join(others, "other", "zo")
        # a group holds at most top-m sources
        others = others.groupBy("target", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other", "zo"))), lambda r: r["zo"]).alias("others"))
        tasks = tasks.join(others, ["target", "source"], "left")
    n = probe.parallelism or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = tasks.repartition(n, "target", "low").sortWithinPartitions("low", "target", "source")
    mode = "candidate_group" if grouped else "pairwise"
    parts = blocks or []
    get, sent = shared.getter(), shared.sent

    def beside(t) -> list[np.ndarray]:
        if not grouped:
            return []
        if sent is not None:
            return [sent.value[ch] for ch in t.group if ch != t.source]
        return [np.asarray(x, float) for x in t.others] if t.others is not None else []

    def run(batches):
        memory: dict = {}
        for batch in batches:
            for t in batch.itertuples(index=False):
                low = int(t.low)
                rows = run_task(int(t.target), int(t.source), mode, get(t, "target", "zt"), get(t, "source", "zs"), beside(t), int(t.before) if grouped else 0, low, min(low + probe.slice, probe.B), splits, replace(probe, seed=int(t.seed)) if seeded else probe, parts, memory)
                yield pd.DataFrame.from_records(list(rows), columns=[c.split()[0] for c in DELTAS.split(", ")])

    # pandas hands NaN over as null
    return tasks.mapInPandas(run, DELTAS).withColumns({c: F.coalesce(c, F.lit(NAN)) for c in ("delta", "var_y", "sst", "max_abs_x", "norm_x")})


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def gates(rows: DataFrame) -> DataFrame:
    """Guards and the candidate flag from delta_true, aligned_gain, n_cert, var_y, sst, max_abs_x, norm_x. NaN fails every gate."""
    def positive(c):
        return is_finite(F.col(c)) & (F.col(c) > 0)

    def at_most(c, eps):
        return ~is_finite(F.col(c)) | (F.col(c) <= eps)

    few = F.col("n_cert") < LEAST_ROWS
    rows = rows.withColumns({
        "gate_delta_true": positive("delta_true"), "gate_aligned_gain": positive("aligned_gain"),
        "near_zero_target_variance": few | at_most("var_y", VARIANCE_EPS) | at_most("sst", VARIANCE_EPS),
        "sparse_zero": few | at_most("max_abs_x", SPARSE_EPS) | at_most("norm_x", SPARSE_EPS),
    })
    unstable = ~is_finite(F.col("delta_true")) | ~is_finite(F.col("aligned_gain")) | F.col("near_zero_target_variance") | F.col("sparse_zero")
    rows = rows.withColumn("unstable_metric", unstable)
    return rows.withColumn("certified_candidate", F.col("gate_delta_true") & F.col("gate_aligned_gain") & ~F.col("unstable_metric"))


def summarized(long: DataFrame, B: int, keys=("target", "source", "mode", "block")) -> DataFrame:
    """An edge a row from long deltas: the null's mean and deviation, aligned gain, p-value, gates. Anything not finite makes them NaN."""
    rest = [c for c in ("alpha_own", "n_train_fit", "n_val_alpha", "n_cert", "var_y", "sst", "max_abs_x", "norm_x") if c in long.columns]
    true = F.col("b") < 0
    s = long.groupBy(*keys).agg(
        F.max(F.when(true, F.col("delta"))).alias("delta_true"), *([F.max(F.when(true, F.col("alpha"))).alias("alpha_joint")] if "alpha" in long.columns else []),
        F.array_sort(F.collect_list(F.when(~true, F.struct("b", "delta")))).alias("nulls"), *[F.max(c).alias(c) for c in rest],
    )
    d = F.col("nulls.delta")
    good = is_finite(F.col("delta_true")) & F.forall(d, is_finite) & (F.size(d) == B)
    total = F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
    s = s.withColumn("good", good).withColumn("mean", F.when(F.col("good"), total / B))
    spread = F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    gain = F.aggregate(d, F.lit(0.0), lambda a, x: a + (F.col("delta_true") - x)) / B
    above = F.size(F.filter(d, lambda x: x >= F.col("delta_true")))
    nan = F.lit(NAN)
    s = s.withColumns({
        "delta_null_mean": F.coalesce("mean", nan), "delta_null_std": F.when(F.col("good"), F.sqrt(spread / B)).otherwise(nan),
        "aligned_gain": F.when(F.col("good"), gain).otherwise(nan), "p_value": F.when(F.col("good"), (above + 1) / F.lit(float(B + 1))).otherwise(nan), "B": F.lit(B),
    })
    return gates(s).drop("nulls", "good", "mean") if "sst" in rest else s.drop("nulls", "good", "mean")


EDGE = (
    "target", "source", "delta_true", "delta_null_mean", "delta_null_std", "aligned_gain", "p_value", "B", "alpha_own", "alpha_joint", "gate_delta_true", "gate_aligned_gain",
    "near_zero_target_variance", "sparse_zero", "unstable_metric", "certified_candidate", "n_train_fit", "n_val_alpha", "n_cert",
)


def certify(panel: DataFrame, edges: DataFrame, splits: S.Splits, probe: Probe) -> DataFrame:
    """Edges with their verdicts on all certification rows."""
    return summarized(deltas(panel, edges, splits, probe), probe.B).drop("block")


# --- one lag, one source: closed form, and a null that SQL can state ----------------------------


def pair_rows(lags: DataFrame) -> DataFrame:
    """(target, source, u, y, x1, x2): own and source lag of every ordered pair of channels."""
    own = lags.select(F.col("ch").alias("target"), "u", "y", F.col("x").alias("x1"))
    return own.join(lags.select(F.col("ch").alias("source"), "u", F.col("x").alias("x2")), "u").where("target <> source")


def shifted(lags: DataFrame, shifts: int, period: int) -> DataFrame:
    """Every pair's rows with the source's lag turned round by b * period // (shifts + 1) rows; b = -1 is the true one."""
    rows = pair_rows(lags).select("target", "source", "u", "y", "x1")
    b = F.explode(F.sequence(F.lit(-1), F.lit(shifts - 1))).alias("b")
    rows = rows.select("*", b)
    turn = F.when(F.col("b") < 0, F.lit(0)).otherwise(F.expr(f"(b + 1) * {period} DIV {shifts + 1}"))
    rows = rows.withColumn("from_u", (F.col("u") - 1 + turn) % period + 1)
    src = lags.select(F.col("ch").alias("source"), F.col("u").alias("from_u"), F.col("x").alias("x2"))
    return rows.join(src, ["source", "from_u"]).select("target", "source", "b", "u", "y", "x1", "x2")


def delta_p1(rows: DataFrame, splits: S.Splits, alpha: float, keys=("target", "source")) -> DataFrame:
    """(keys, delta, n_cert, var_y, sst, max_abs_x, norm_x) of x2 beside x1, both by ridge with one alpha."""
    from . import ridge
    from .lagged import within

    fit, cert = within(rows, splits.train_fit), within(rows, splits.cert)
    joint = ridge.path_p2(fit, [alpha], keys).select(*keys, "b1", "b2", F.col("intercept").alias("b0"))
    own = ridge.path_p1(fit.withColumnRenamed("x1", "x"), [alpha], keys).select(*keys, "slope", "intercept")
    all_ = cert.join(joint.join(own, list(keys)), list(keys))
    e1 = F.col("y") - F.col("slope") * F.col("x1") - F.col("intercept")
    e2 = F.col("y") - F.col("b1") * F.col("x1") - F.col("b2") * F.col("x2") - F.col("b0")
    s = all_.groupBy(*keys).agg(
        F.sum(e1 * e1).alias("s1"), F.sum(e2 * e2).alias("s2"), F.count("*").alias("n_cert"), F.var_pop("y").alias("var_y"), (F.count("*") * F.var_pop("y")).alias("sst"),
        F.max(F.abs("x2")).alias("max_abs_x"), F.sqrt(F.sum(F.col("x2") * F.col("x2"))).alias("norm_x"),
    )
    d = F.when(F.col("sst") <= VARIANCE_EPS, F.lit(NAN)).otherwise((F.col("s1") - F.col("s2")) / F.when(F.col("sst") <= VARIANCE_EPS, 1.0).otherwise(F.col("sst")))
    return s.select(*keys, d.alias("delta"), "n_cert", "var_y", "sst", "max_abs_x", "norm_x")
