"""Streams: hourly channel sums with a watermark, and scoring of new rows by a certified model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_sums(events: DataFrame, *, late: str = "2 hours") -> DataFrame:
    """(hour, channel, v) of a stream (or table) of events with ts, event_type, value; rows later than the watermark are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    sums = rows.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("channel")).agg(F.sum("value").alias("v"))
    return sums.select(F.col("w.start").alias("hour"), "channel", "v")


def scored(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Rows (ch, u, y, x) with the prediction of a one-lag model (ch, slope, intercept): a stream-static join."""
    return rows.join(model.select("ch", "slope", "intercept"), "ch").withColumn("pred", F.col("slope") * F.col("x") + F.col("intercept"))
