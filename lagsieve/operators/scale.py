"""Standard scaling per channel, fitted on the fit rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.splits import Splits


def scaler_stats(panel: DataFrame, splits: Splits) -> DataFrame:
    """(ch, channel, mean, scale): population deviation, 1 where it is 0."""
    r = splits.train_fit
    stats = panel.where((F.col("t") >= r.start) & (F.col("t") < r.end)).groupBy("ch", "channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return stats.select("ch", "channel", "mean", F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd")).alias("scale"))


def scaled(panel: DataFrame, splits: Splits, *, include_test: bool = False) -> DataFrame:
    """(t, ch, channel, v, z) of the rows before the test window."""
    rows = panel if include_test else panel.where(F.col("t") < splits.pre_test.end)
    stats = scaler_stats(panel, splits).select("ch", "mean", "scale")
    return rows.join(stats, "ch").select("t", "ch", "channel", "v", ((F.col("v") - F.col("mean")) / F.col("scale")).alias("z"))
