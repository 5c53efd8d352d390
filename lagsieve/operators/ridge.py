"""One- and two-feature ridge in closed form, as aggregates; least squares and partial fits with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.splits import Splits
from .lagged import within

TINY = 1e-12


def grid(df: DataFrame, alphas) -> DataFrame:
    """Each row with every alpha of a short grid, in order."""
    values = F.array(*[F.lit(float(a)) for a in alphas])
    return df.select("*", F.posexplode(values).alias("alpha_idx", "alpha"))


def path_p1(rows: DataFrame, alphas, keys=("ch",)) -> DataFrame:
    """(keys, alpha_idx, alpha, slope, intercept, df, gcv) of y on x: what ridge_path gives for one column."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"))
    g = grid(s, alphas)
    slope = F.col("n") * F.col("cxy") / (F.col("n") * F.col("vx") + F.col("alpha"))
    df = F.col("n") * F.col("vx") / (F.col("n") * F.col("vx") + F.col("alpha"))
    g = g.select(*keys, "n", "alpha_idx", "alpha", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), df.alias("df"), (F.col("vy") - 2 * slope * F.col("cxy") + slope * slope * F.col("vx")).alias("mse"))
    room = 1 - F.col("df") / F.col("n")
    return g.select(*keys, "alpha_idx", "alpha", "slope", "intercept", "df", (F.col("mse") / (room * room)).alias("gcv"))


def path_p2(rows: DataFrame, alphas, keys=("ch",)) -> DataFrame:
    """(keys, alpha_idx, alpha, b1, b2, intercept) of y on x1 and x2, by the 2 x 2 normal equations."""
    s = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("x1", "x2", "y")], F.var_pop("x1").alias("s11"), F.var_pop("x2").alias("s22"),
        F.covar_pop("x1", "x2").alias("s12"), F.covar_pop("x1", "y").alias("s1y"), F.covar_pop("x2", "y").alias("s2y"),
    )
    g = grid(s, alphas)
    a, b, c, p, q = (F.col("n") * F.col(k) for k in ("s11", "s12", "s22", "s1y", "s2y"))
    a, c = a + F.col("alpha"), c + F.col("alpha")
    det = a * c - b * b
    g = g.withColumns({"b1": (c * p - b * q) / det, "b2": (a * q - b * p) / det})
    return g.select(*keys, "alpha_idx", "alpha", "b1", "b2", (F.col("my") - F.col("b1") * F.col("mx1") - F.col("b2") * F.col("mx2")).alias("intercept"))


def gcv_alpha(paths: DataFrame, keys=("ch",)) -> DataFrame:
    """The first alpha of least GCV."""
    return paths.groupBy(*keys).agg(F.min_by("alpha", F.struct("gcv", "alpha_idx")).alias("alpha"))


def squared_errors(rows: DataFrame, paths: DataFrame, keys=("ch",)) -> DataFrame:
    """(keys, alpha_idx, alpha, slope, intercept, mse) of each alpha on the rows."""
    joined = rows.join(paths, list(keys))
    e = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")
    return joined.groupBy(*keys, "alpha_idx", "alpha", "slope", "intercept").agg(F.avg(e * e).alias("mse"))


def fitted_p1(rows: DataFrame, splits: Splits, alphas, keys=("ch",), rule: str = "val_grid") -> DataFrame:
    """(keys, alpha, slope, intercept): fitted on fit rows, alpha chosen on alpha rows (the first of equals) or by GCV."""
    paths = path_p1(within(rows, splits.train_fit), alphas, keys)
    scored = squared_errors(within(rows, splits.val_alpha), paths, keys) if rule == "val_grid" else paths.withColumnRenamed("gcv", "mse")
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("alpha", "slope", "intercept"), F.struct("mse", "alpha_idx")).alias("best"))
    return best.select(*keys, "best.*")


def r2(sse: Column, sst: Column) -> Column:
    """1 - SSE / SST; NaN where SST says nothing."""
    return F.when(sst <= TINY, F.lit(float("nan"))).otherwise(1 - sse / F.when(sst <= TINY, F.lit(1.0)).otherwise(sst))


def oos_r2(rows: DataFrame, fits: DataFrame, splits: Splits, keys=("ch",)) -> DataFrame:
    """(keys, n, r2) on the certification rows, against their mean."""
    joined = within(rows, splits.cert).join(fits, list(keys))
    e = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")
    s = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), (F.count("*") * F.var_pop("y")).alias("sst"))
    return s.select(*keys, "n", r2(F.col("sse"), F.col("sst")).alias("r2"))


def ols_p1(rows: DataFrame, keys=("ch",)) -> DataFrame:
    """(keys, slope, intercept, r2) of y on x with an intercept."""
    return rows.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def residualized_p1(rows: DataFrame, keys=("ch",)) -> DataFrame:
    """Each row's y without its projection on x."""
    return rows.join(ols_p1(rows, keys).drop("r2"), list(keys)).select(*keys, "u", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).alias("resid"))


def incremental_r2(rows: DataFrame, keys=("target", "source")) -> DataFrame:
    """(keys, direct, partial) for y on x1, then x2 as well: the gain in R2, and the same through residuals."""
    s = rows.groupBy(*keys).agg(
        F.var_pop("y").alias("vy"), F.var_pop("x1").alias("a"), F.var_pop("x2").alias("c"), F.covar_pop("x1", "x2").alias("b"), F.covar_pop("x1", "y").alias("p"), F.covar_pop("x2", "y").alias("q")
    )
    a, b, c, p, q, v = (F.col(k) for k in ("a", "b", "c", "p", "q", "vy"))
    joint = (c * p * p - 2 * b * p * q + a * q * q) / (a * c - b * b) / v
    partial_cov, partial_var = q - b * p / a, c - b * b / a
    return s.select(*keys, (joint - p * p / a / v).alias("direct"), (partial_cov * partial_cov / partial_var / v).alias("partial"))
