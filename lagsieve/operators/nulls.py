"""Null series: phase surrogates of each source, known by (source, b) and by nothing of a target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from .series import series

KEY = "dataset string, split string, source int, b int, seed long, n int, z array<double>"


def surrogates(panel: DataFrame, B: int, seed: int, *, dataset: str = "", split: str = "pre_test", sources: list[int] | None = None) -> DataFrame:
    """(dataset, split, source, b, seed, n, z) for b in [0, B): each made from its key alone, wherever it is made."""
    keys = series(panel).withColumnRenamed("ch", "source")
    if sources is not None:
        keys = keys.where(F.col("source").isin(sources))
    keys = keys.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1)))).repartition(F.col("source"), F.col("b"))
    return made(keys, seed, dataset, split)


def made(keys: DataFrame, seed: int, dataset: str, split: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [K.surrogate(np.asarray(z, float), int(s), int(b), seed) for s, b, z in zip(batch["source"], batch["b"], batch["z"])]
            yield pd.DataFrame({"dataset": dataset, "split": split, "source": batch["source"], "b": batch["b"], "seed": seed, "n": [len(x) for x in out], "z": out})

    return keys.select("source", "b", "z").mapInPandas(run, KEY)


def cached(spark: SparkSession, path: str, panel: DataFrame, B: int, seed: int, *, dataset: str = "", split: str = "pre_test") -> tuple[DataFrame, int]:
    """(the bank, how many of it were missing): what the stored table lacks is made and appended."""
    wanted = series(panel).withColumnRenamed("ch", "source").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1)))).withColumn("n", F.size("z"))
    try:
        have = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = spark.createDataFrame([], KEY)
    mine = (F.col("dataset") == dataset) & (F.col("split") == split) & (F.col("seed") == seed)
    missing = wanted.join(have.where(mine).select("source", "b", "n"), ["source", "b", "n"], "left_anti")
    count = missing.count()
    if count:
        made(missing, seed, dataset, split).write.mode("append").parquet(path)
    stored = spark.read.parquet(path).where(mine)
    return stored.join(wanted.select("source", "b", "n"), ["source", "b", "n"], "left_semi"), count
