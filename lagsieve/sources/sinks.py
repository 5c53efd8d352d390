"""Sinks and lineage: edge tables as Parquet, figure rows as TSV, summaries as JSON, run names."""

from __future__ import annotations

import json
import subprocess
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, config_hash

SCHEMA_VERSION = "1"
LINEAGE = ("schema_version", "run_id", "config_hash", "git_hash", "seed", "dataset", "pred_len", "tier", "mode", "alpha_rule")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that driver and executors share; only in local mode may that be unnamed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lagsieve-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(path: str):
    """(pyarrow's file system, path in it), for files that kernels write below a scratch folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def run_id(config: Config) -> str:
    return f"{config.dataset}_pl{config.pred_len}_{config.tier}_{config_hash(config)}"


def git_hash() -> str:
    try:
        out = subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10)
        return out.stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def with_lineage(edges: DataFrame, config: Config, mode: str = "pairwise", alpha_rule: str = "val_grid") -> DataFrame:
    values = (SCHEMA_VERSION, run_id(config), config_hash(config), git_hash(), config.seed, config.dataset, config.pred_len, config.tier, mode, alpha_rule)
    return edges.withColumns({k: F.lit(v) for k, v in zip(LINEAGE, values)})


def write_edges(edges: DataFrame, folder: str) -> str:
    path = f"{folder}/edges.parquet"
    edges.write.mode("overwrite").parquet(path)
    return path


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A few numbers as one JSON document, through Spark's writer, so that the path may be in any store."""
    text = json.dumps(summary, indent=None, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
