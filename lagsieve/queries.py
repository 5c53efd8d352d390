"""Named queries over the star-schema tables, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Dataset
from .operators import admission as A
from .operators import association as X
from .operators import innovation as I
from .operators import lagged as L
from .operators import nulls as N
from .operators import probe as P
from .operators import ridge as R
from .operators import scale as Z
from .operators import screen as SC
from .plans import pipelines as J
from .plans import splits as S
from .sources import panel as sources
from .sources import sinks

HOURS, LOOKBACK = 720, 24
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0)
ALPHA, SHIFTS = 1.0, 19
SPLITS = S.splits_for("synthetic", HOURS, LOOKBACK)
PRE = SPLITS.pre_test.end
#: For the kernel queries: short windows and few surrogates.
SMALL = Config("", "events", 1, 6, 0, "sanity", stability_blocks=3, alpha_grid=ALPHAS, B=19)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits (and no negative zero), so that summation order doesn't show."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def zpanel(spark: SparkSession, sf: str) -> DataFrame:
    return Z.scaled(sources.events_hourly(spark, sf, HOURS), SPLITS)


def lags(spark: SparkSession, sf: str) -> DataFrame:
    return L.pair_lags(zpanel(spark, sf))


def fit(rows: DataFrame) -> DataFrame:
    return L.within(rows, SPLITS.train_fit)


def two_lags(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.design(zpanel(spark, sf), 2, 1)
    return rows.select("ch", "u", "y", F.col("x")[1].alias("x1"), F.col("x")[0].alias("x2"))


def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges made from orders, with p-values on a fixed lattice of which some are small: (target, source, p_value, certified_candidate, B, aligned_gain, coherence_peak, delta_true, edge_type)."""
    o = sources.table(spark, sf, "orders")
    x = (F.col("o_orderkey") * 37 % 997 + 1) / F.lit(998.0)
    p = x * x * x * x
    return o.select(
        (F.col("o_custkey") % 12).cast("int").alias("target"), F.col("o_orderkey").alias("source"), F.when(F.col("o_orderkey") % 101 == 0, F.lit(float("nan"))).otherwise(p).alias("p_value"),
        (F.col("o_orderkey") % 3 != 0).alias("certified_candidate"), (F.col("o_orderkey") % 2 * 300 + 20).cast("int").alias("B"),
        (F.col("o_totalprice") / 1e5 - 1).alias("aligned_gain"), (F.col("o_orderkey") * 53 % 1009 / F.lit(1009.0)).alias("coherence_peak"),
        (F.col("o_totalprice") / 2e5 - 0.5).alias("delta_true"), F.element_at(F.array(F.lit("TRUE"), F.lit("NULL"), F.lit("DECOY")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("edge_type"),
    )


def order_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of three blocks on the same edges; a block may list an edge twice."""
    e = order_edges(spark, sf).select("target", "source")
    return e.select("target", "source", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(2))).alias("block")).withColumn("certified_candidate", (F.col("source") * 7 + F.col("block") * 3) % 5 < 3)


def shift_null(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by turned-round copies of the source: one lag, one alpha."""
    rows = P.shifted(lags(spark, sf), SHIFTS, PRE - 1)
    long = P.delta_p1(rows, SPLITS, ALPHA, ("target", "source", "b"))
    # guards look at the true source's rows
    true = F.col("b") < 0
    long = long.withColumns({c: F.when(true, F.col(c)) for c in ("max_abs_x", "norm_x")})
    return P.summarized(long, SHIFTS, ("target", "source"))


def gate_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of every kind, NaN, infinity and null among them, made from lineitem."""
    l = sources.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_discount").alias("d"), F.var_pop("l_quantity").alias("v"), F.max("l_tax").alias("m"))
    k = F.col("l_suppkey")
    nan = F.lit(float("nan"))
    return l.select(
        k.alias("edge"), F.when(k % 11 == 0, nan).otherwise(F.when(k % 13 == 0, F.lit(float("inf"))).otherwise(F.col("d") - 0.05)).alias("delta_true"),
        F.when(k % 7 == 0, nan).otherwise(F.lit(0.0501) - F.col("d")).alias("aligned_gain"), F.when(k % 5 == 0, F.lit(7)).otherwise(F.col("n").cast("int")).alias("n_cert"),
        F.when(k % 17 == 0, F.lit(0.0)).otherwise(F.col("v")).alias("var_y"), F.when(k % 17 == 0, F.lit(0.0)).otherwise(F.col("v") * F.col("n")).alias("sst"),
        F.when(k % 19 == 0, F.lit(0.0)).otherwise(F.col("m")).alias("max_abs_x"), F.when(k % 19 == 0, F.lit(0.0)).otherwise(F.col("m") * 3).alias("norm_x"),
    )


def certified_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The shift-null verdicts, with every edge of positive gain admitted."""
    return shift_null(spark, sf).withColumn("e_certified", F.col("gate_aligned_gain"))


def screen_p1(spark: SparkSession, sf: str) -> DataFrame:
    return SC.scores_p1(lags(spark, sf), SPLITS, ALPHAS)


def long_design(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.assert_before_test(L.design(zpanel(spark, sf), 3, 2), SPLITS.test.start)
    return rounded(L.features(rows, 3).select("ch", "u", "origin", "y", "feature", "value"))


def pair_design(spark: SparkSession, sf: str) -> DataFrame:
    d = L.design(zpanel(spark, sf), 2, 2)
    pairs = L.with_sources(d.select("ch", "u", "y", "x"), d)
    return rounded(L.features(L.within(pairs, SPLITS.cert), 2).select("target", "source", "u", "y", "feature", "value"))


def recovery(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.by_label(order_edges(spark, sf), ["TRUE", "NULL", "DECOY", "NONE"]))


def certified(spark: SparkSession, sf: str) -> DataFrame:
    panel = zpanel(spark, sf)
    return P.certify(panel, P.pairs(panel), SPLITS, J.probe_of(SMALL, SMALL.B))


def queries() -> dict:
    r6 = lambda f, digits=6: lambda s, d: rounded(f(s, d), digits)
    return {
        "panel_hourly": r6(lambda s, d: sources.events_hourly(s, d, HOURS)),
        "panel_orders": r6(sources.orders_daily, 4),
        "panel_lineitem": r6(sources.lineitem_daily),
        "panel_users": r6(lambda s, d: sources.users_hourly(s, d, HOURS).groupBy("ch", "channel").agg(F.count("*").alias("rows"), F.sum("v").alias("total"))),
        "smoke_source": r6(lambda s, d: sources.smoke(s)),
        "splits_table": lambda s, d: S.table(s, SPLITS),
        "cert_blocks": lambda s, d: S.in_blocks(zpanel(s, d).select("t", "ch"), SPLITS, 3).groupBy("ch", "block").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")),
        "split_roles": lambda s, d: zpanel(s, d).groupBy("ch", S.role(SPLITS, F.col("t")).alias("split")).agg(F.count("*").alias("n")),
        "scaler_stats": r6(lambda s, d: Z.scaler_stats(sources.events_hourly(s, d, HOURS), SPLITS)),
        "scaled_panel": r6(lambda s, d: zpanel(s, d).select("t", "ch", "channel", "z")),
        "lagged_design": long_design,
        "own_source_design": pair_design,
        "ridge_p1_path": r6(lambda s, d: R.path_p1(fit(lags(s, d)), ALPHAS)),
        "ridge_p2_path": r6(lambda s, d: R.path_p2(fit(two_lags(s, d)), ALPHAS)),
        "gcv_alpha_p1": lambda s, d: R.gcv_alpha(R.path_p1(fit(lags(s, d)), ALPHAS)),
        "valgrid_alpha_p1": r6(lambda s, d: R.fitted_p1(lags(s, d), SPLITS, ALPHAS)),
        "oos_r2": r6(lambda s, d: R.oos_r2(lags(s, d), R.fitted_p1(lags(s, d), SPLITS, ALPHAS), SPLITS)),
        "ols_p1": r6(lambda s, d: R.ols_p1(fit(lags(s, d)))),
        "residualize_p1": r6(lambda s, d: R.residualized_p1(fit(lags(s, d)))),
        "incremental_r2": r6(lambda s, d: R.incremental_r2(fit(P.pair_rows(lags(s, d))))),
        "innovation_own_p1": r6(lambda s, d: I.innovations_p1(lags(s, d), SPLITS, ALPHAS)),
        "innovation_describe": r6(lambda s, d: I.described(I.innovations_p1(lags(s, d), SPLITS, ALPHAS))),
        "screen_p1": r6(screen_p1),
        "screen_topm": lambda s, d: SC.ranked(screen_p1(s, d), 2).select("target", "source", "screen_rank", "passed_screen"),
        "delta_r2_p1": r6(lambda s, d: P.delta_p1(P.pair_rows(lags(s, d)), SPLITS, ALPHA).select("target", "source", "delta", "n_cert")),
        "shift_null_p1": r6(lambda s, d: shift_null(s, d).select("target", "source", "delta_true", "delta_null_mean", "delta_null_std", "aligned_gain", "p_value", "certified_candidate")),
        # the kernels of the certifier, with a null that SQL can state
        "certify_shift_kernel": r6(lambda s, d: certified_by_shift(s, d).select("target", "source", "delta_true", "delta_null_mean", "delta_null_std", "aligned_gain", "p_value", "certified_candidate")),
        "csv_source": r6(csv_source),
        "evidence_matrix": r6(lambda s, d: X.evidence_matrix(shift_null(s, d), "aligned_gain")),
        "gates_guards": lambda s, d: P.gates(gate_cases(s, d)).select("edge", "gate_delta_true", "gate_aligned_gain", "near_zero_target_variance", "sparse_zero", "unstable_metric", "certified_candidate"),
        "bh_global": lambda s, d: A.benjamini_hochberg(order_edges(s, d)).select("target", "source", "fdr_q", "fdr_pass", "fdr_underpowered"),
        "bh_per_target": lambda s, d: A.benjamini_hochberg(order_edges(s, d), per=("target",)).select("target", "source", "fdr_q", "fdr_pass", "fdr_underpowered"),
        "stability_select": r6(lambda s, d: A.stability(order_edges(s, d), order_blocks(s, d), 3).select("target", "source", "stability_fraction", "stability_pass", "stability_k", "stability_min_fraction")),
        "admission": lambda s, d: A.admit(A.stability(A.benjamini_hochberg(order_edges(s, d), per=("target",)), order_blocks(s, d), 3)).select("target", "source", "e_certified"),
        "admission_summary": lambda s, d: A.summary(A.admit(A.stability(A.benjamini_hochberg(order_edges(s, d), per=("target",)), order_blocks(s, d), 3))),
        "adjacency_pivot": r6(lambda s, d: A.adjacency(certified_grid(s, d), 5)),
        "recall_curve": r6(lambda s, d: A.recall_curve(SC.ranked(screen_p1(s, d)), certified_grid(s, d), 4)),
        "xcorr_absmax": r6(lambda s, d: X.xcorr_absmax(zpanel(s, d))),
        "power_spectrum": r6(lambda s, d: X.power_spectrum(zpanel(s, d), PRE), 4),
        "circular_autocorr": r6(lambda s, d: X.circular_autocorrelation(zpanel(s, d), PRE, 24)),
        "coherence_welch": r6(lambda s, d: X.coherence(zpanel(s, d), PRE), 4),
        "spearman_pairs": r6(lambda s, d: X.spearman_pairs(zpanel(s, d))),
        "spearman_screen": r6(lambda s, d: X.spearman(order_edges(s, d), "p_value", "coherence_peak", ("target",))),
        "ks_uniform": r6(lambda s, d: X.ks_uniform(order_edges(s, d), ("target",))),
        "ecdf": r6(lambda s, d: X.ecdf(order_edges(s, d).withColumn("x_", F.col("p_value")), "x_", ("edge_type",))),
        "recovery_summary": recovery,
        "top_rejected": r6(lambda s, d: X.top_rejected(order_edges(s, d))),
        "direction_asymmetry": r6(lambda s, d: X.asymmetry(shift_null(s, d))),
        # kernels: no SQL states these; the tests pin them
        "innovation_own": r6(lambda s, d: I.innovations(zpanel(s, d), SPLITS, 6, 1, ALPHAS)),
        "surrogate_bank": r6(lambda s, d: N.surrogates(zpanel(s, d), 5, 0, dataset="events").select("source", "b", "n", F.posexplode("z").alias("t", "z"))),
        "screen": r6(lambda s, d: SC.screen(zpanel(s, d), SPLITS, 6, 1, ALPHAS)),
        "screen_users": r6(lambda s, d: screen_users(s, d)),
        "certify_pairwise_phase": r6(certified),
        "certify_row_perm": r6(lambda s, d: P.certify(zpanel(s, d), P.pairs(zpanel(s, d)), SPLITS, J.probe_of(SMALL.with_(null_method="row_perm"), 9))),
        "certify_group": r6(lambda s, d: J.screen_then_certify(zpanel(s, d), SPLITS, SMALL, top=2)["group"]),
        "screen_then_certify": r6(lambda s, d: J.screen_then_certify(zpanel(s, d), SPLITS, SMALL, top=2)["pairwise"]),
        "reference_pipeline": r6(lambda s, d: J.reference(zpanel(s, d), SPLITS, SMALL).drop("git_hash")),
        "planted_acceptance": r6(lambda s, d: J.planted(s)),
        "association_run": r6(lambda s, d: J.association_rows(zpanel(s, d), SPLITS, SMALL.with_(B=9), PRE)),
        "calibration_pairs": r6(lambda s, d: J.calibration(s)),
        "calibration_summary": r6(lambda s, d: X.ks_uniform(J.calibration(s).withColumn("all", F.lit(1)), ("all",)).drop("all")),
        "recovery_run": r6(lambda s, d: J.recovery(s)),
        "recovery_run_summary": r6(lambda s, d: J.recovery_summary(J.recovery(s))),
    }


def screen_users(spark: SparkSession, sf: str) -> DataFrame:
    """The wide panel: top sources of every user, by one lag."""
    return SC.ranked(SC.wide_p1(sources.users_sums(spark, sf, HOURS), SPLITS, ALPHAS, sinks.scratch(spark, "screen-users"))).where("passed_screen")


def certified_by_shift(spark: SparkSession, sf: str) -> DataFrame:
    panel = zpanel(spark, sf)
    return P.certify(panel, P.pairs(panel), SPLITS, P.Probe(1, 1, (ALPHA,), SHIFTS, null_method="shift", slice=7))


def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly panel by way of a CSV file, of which only the rows before the test window are read."""
    wide = sources.events_hourly(spark, sf, HOURS).groupBy("t").pivot("channel").agg(F.first("v")).orderBy("t")
    dated = wide.select(F.expr(f"date_format(TIMESTAMP '{sources.HOUR_ZERO}' + make_dt_interval(0, CAST(t AS INT)), 'yyyy-MM-dd HH:mm:ss')").alias("date"), *[c for c in wide.columns if c != "t"])
    path = sinks.scratch(spark, "csv-source")
    dated.coalesce(1).write.option("header", True).csv(path)
    return sources.csv_panel(spark, path, Dataset("events", path, "ETT_hour", None), PRE)


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: how much of next hour's activity of each event type its own last hour explains, out of sample."""
    return queries()["oos_r2"](spark, sf)
