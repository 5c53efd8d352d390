"""Lagged designs as window expressions: a row for each channel and predicted row u."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.splits import Range


def design(panel: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """(ch, u, origin, y, x): the lookback values that end horizon rows before u, oldest first; incomplete windows are left out."""
    if lookback <= 0 or horizon <= 0:
        raise ValueError("lookback and horizon must be positive")
    frame = W.partitionBy("ch").orderBy("t").rowsBetween(-(horizon + lookback - 1), -horizon)
    out = panel.select("ch", F.col("t").alias("u"), (F.col("t") - horizon + 1).alias("origin"), F.col("z").alias("y"), F.collect_list("z").over(frame).alias("x"))
    return out.where(F.size("x") == lookback)


def pair_lags(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """(ch, u, y, x) with a single lag, without arrays."""
    return panel.select("ch", F.col("t").alias("u"), F.col("z").alias("y"), F.lag("z", horizon).over(W.partitionBy("ch").orderBy("t")).alias("x")).where("x IS NOT NULL")


def with_sources(own: DataFrame, sources: DataFrame) -> DataFrame:
    """(target, source, u, y, x): own window and then the source's, for every other channel, joined on u."""
    s = sources.select(F.col("ch").alias("source"), "u", F.col("x").alias("xs"))
    return own.withColumnRenamed("ch", "target").join(s, "u").where("target <> source").select("target", "source", "u", "y", F.concat("x", "xs").alias("x"))


def features(design_rows: DataFrame, lookback: int) -> DataFrame:
    """Long form (…, feature, value): own[ch]_lag_k or source_j[j]_lag_k, oldest first."""
    pairs = "source" in design_rows.columns
    own = F.concat(F.lit("own["), F.col("target" if pairs else "ch"), F.lit("]_lag_"))
    other = F.concat(F.lit("source_"), F.col("source"), F.lit("["), F.col("source"), F.lit("]_lag_")) if pairs else own
    rest = [c for c in design_rows.columns if c != "x"]
    long = design_rows.select(*rest, F.posexplode("x").alias("pos", "value"))
    name = F.when(F.col("pos") < lookback, F.concat(own, (lookback - F.col("pos")).cast("string"))).otherwise(F.concat(other, (2 * lookback - F.col("pos")).cast("string")))
    return long.select(*rest, name.alias("feature"), "value")


def within(rows: DataFrame, r: Range, column: str = "u") -> DataFrame:
    return rows.where((F.col(column) >= r.start) & (F.col(column) < r.end))


def assert_before_test(rows: DataFrame, end: int, column: str = "u") -> DataFrame:
    """The rows; one in the test window is an error when it is read."""
    return rows.withColumn(column, F.when(F.col(column) < end, F.col(column)).otherwise(F.raise_error(F.lit("a row of the test window")).cast("long")))
