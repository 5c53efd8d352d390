"""Sources: tables and files as a long panel (t, ch, channel, v), without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..config import Config, Dataset, dataset, dataset_path
from ..plans import splits as S

HOUR_ZERO, DAY_ZERO = "2024-01-01 00:00:00", "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour(ts: str) -> Column:
    return F.expr(f"(unix_micros(CAST({ts} AS TIMESTAMP)) - unix_micros(TIMESTAMP '{HOUR_ZERO}')) DIV 3600000000")


def gridded(rows: DataFrame, t0: int, t1: int) -> DataFrame:
    """(t, channel, v) summed and filled with zeros over all t of [t0, t1) and all channels; channels are numbered in order of their names. The range of t is sent to the channels: its length doesn't depend on how many rows or channels there are."""
    sums = rows.groupBy("t", "channel").agg(F.sum("v").alias("v"))
    # distinct names are few next to the rows they come from
    named = rows.select("channel").distinct().withColumn("ch", (F.row_number().over(W.orderBy("channel")) - 1).cast("int"))
    times = rows.sparkSession.range(t0, t1).select(F.col("id").alias("t"))
    grid = named.crossJoin(F.broadcast(times))  # time by channel, each once: the panel itself
    return grid.join(sums, ["t", "channel"], "left").select((F.col("t") - t0).alias("t"), "ch", "channel", F.coalesce("v", F.lit(0.0)).alias("v"))


def within_hours(rows: DataFrame, hours: int) -> DataFrame:
    """The rows; one outside the panel's hours is an error when it is read."""
    out = (F.col("t") < 0) | (F.col("t") >= hours)
    return rows.withColumn("v", F.when(out, F.raise_error(F.concat(F.lit("an event outside the panel: hour "), F.col("t"))).cast("double")).otherwise(F.col("v")))


def events_hourly(spark: SparkSession, sf_dir: str, hours: int = 720) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(hour("ts").alias("t"), F.col("event_type").alias("channel"), F.col("value").alias("v"))
    return gridded(within_hours(rows, hours), 0, hours)


def user_rows(spark: SparkSession, sf_dir: str, hours: int) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(hour("ts").alias("t"), F.lpad(F.col("user_id").cast("string"), 12, "0").alias("channel"), F.col("value").alias("v"))
    return within_hours(rows, hours)


def users_hourly(spark: SparkSession, sf_dir: str, hours: int = 720) -> DataFrame:
    return gridded(user_rows(spark, sf_dir, hours), 0, hours)


def users_sums(spark: SparkSession, sf_dir: str, hours: int = 720) -> DataFrame:
    """(ch, t, v): the panel of users_hourly without the zeros that fill it; a channel of nothing else has one row without t and v."""
    # no name is empty, and nulls come first, too
    rows = user_rows(spark, sf_dir, hours).withColumn("name", F.coalesce("channel", F.lit("")))
    named = rows.select("name").distinct().withColumn("ch", (F.row_number().over(W.orderBy("name")) - 1).cast("int"))
    sums = rows.groupBy("name", "t").agg(F.sum(F.when(F.col("channel").isNotNull(), F.col("v"))).alias("v")).where("t IS NOT NULL AND v IS NOT NULL")
    return named.join(sums, "name", "left").select("ch", "t", "v")


def daily(rows: DataFrame, day: str, channel: Column, value: str) -> DataFrame:
    t = F.datediff(F.to_date(day), F.lit(DAY_ZERO).cast("date")).cast("long")
    rows = rows.select(t.alias("t"), channel.alias("channel"), F.col(value).alias("v"))
    ends = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return gridded(rows, ends["a"] or 0, (ends["b"] or -1) + 1)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(table(spark, sf_dir, "orders"), "o_orderdate", F.col("o_orderpriority"), "o_totalprice")


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(table(spark, sf_dir, "lineitem"), "l_shipdate", F.concat("l_returnflag", "l_linestatus"), "l_quantity")


def smoke(spark: SparkSession, rows: int = 720, channels: int = 4) -> DataFrame:
    """x_k(t) = sin(t / (7 + k)) + 0.1 k cos(t / (17 + k))."""
    k, t = F.col("ch"), F.col("t").cast("double")
    grid = spark.range(rows).select(F.col("id").alias("t")).crossJoin(spark.range(channels).select(F.col("id").cast("int").alias("ch")))
    return grid.select("t", "ch", F.concat(F.lit("x"), "ch").alias("channel"), (F.sin(t / (k + 7.0)) + k * 0.1 * F.cos(t / (k + 17.0))).alias("v"))


def channel_order(columns: list[str], info: Dataset) -> list[str]:
    """The channels of a file: Custom files put their target last; M and MS drop the first column of a dated file; S keeps the target."""
    if info.kind == "Custom":
        for needed in ("date", info.target):
            if needed not in columns:
                raise ValueError(f"{info.name} has no column {needed}")
        columns = ["date", *(c for c in columns if c not in ("date", info.target)), info.target]
    if info.features in ("M", "MS"):
        return columns[1:] if "date" in columns else columns
    if info.features == "S":
        if info.target not in columns:
            raise ValueError(f"{info.name} has no column {info.target}")
        return [info.target]
    raise ValueError(f"unknown features policy: {info.features}")


def csv_rows(spark: SparkSession, path: str) -> int:
    """Rows of a file with a header, as the reader counts them."""
    n = spark.read.option("header", True).csv(path).count()
    if not n:
        raise ValueError(f"{path} has no rows")
    return n


def csv_panel(spark: SparkSession, path: str, info: Dataset, read_until: int) -> DataFrame:
    """The first read_until rows of a file, in the file's order, as a long panel. Rows are numbered and cut as text; no value of a later row is parsed."""
    names = spark.read.option("header", True).csv(path).columns
    channels = channel_order(names, info)
    if info.channels is not None and len(channels) != info.channels:
        raise ValueError(f"{info.name} should have {info.channels} channels, not {len(channels)}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.option("header", True).schema(text).csv(path)
    # a row's number: how many rows the file's earlier splits hold, and its place in its own
    raw = raw.select(*[F.col(f"`{n}`") for n in names], F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    splits = sorted((r["_start"], r["n"], r["low"]) for r in raw.groupBy("_start").agg(F.count("*").alias("n"), F.min("_row").alias("low")).collect())  # one row a split of the file
    before, at = [], 0
    for start, n, low in splits:
        before.append((start, at - low))
        at += n
    offsets = spark.createDataFrame(before, "_start long, _before long")
    wide = raw.join(F.broadcast(offsets), "_start").withColumn("t", F.col("_row") + F.col("_before")).where(F.col("t") < read_until)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ch"), F.lit(c).alias("channel"), F.trim(F.col(f"`{c}`")).cast("double").alias("v")) for i, c in enumerate(channels)]))
    return wide.select("t", cells.alias("cell")).select("t", "cell.ch", "cell.channel", "cell.v")


def finite(panel: DataFrame) -> DataFrame:
    """The panel; a value that isn't a finite number is an error when it is read."""
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    return panel.withColumn("v", F.when(ok, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not finite: channel "), "channel", F.lit(" at t="), F.col("t"))).cast("double")))


def load(spark: SparkSession, config: Config, *, include_test: bool = False) -> tuple[DataFrame, S.Splits]:
    """(scaled panel of the rows before the test window, splits) of a configured dataset."""
    from ..functions import generators
    from ..operators.scale import scaled

    info = dataset(config.dataset)
    if info.name == "synthetic_planted":
        made = generators.panel(spark, generators.planted(config.seed))
        return made, S.planted_splits()[0]
    path = dataset_path(config.data_root, info)
    n = 720 if info.kind == "synthetic" else csv_rows(spark, path)
    splits = S.splits_for(info.kind, n, config.lookback, config.split_ratios, config.stability_blocks)
    until = n if include_test else splits.pre_test.end
    raw = smoke(spark, n).where(F.col("t") < until) if info.kind == "synthetic" else csv_panel(spark, path, info, until)
    return scaled(finite(raw), splits), splits
