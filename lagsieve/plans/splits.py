"""Half-open row ranges: benchmark borders, the carve before the test window, blocks, and their DataFrame form."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    start: int
    end: int

    def __post_init__(self):
        if not 0 <= self.start <= self.end:
            raise ValueError(f"not a range: [{self.start}, {self.end})")

    @property
    def length(self) -> int:
        return self.end - self.start

    def overlaps(self, other: Range) -> bool:
        return self.start < other.end and other.start < self.end


@dataclass(frozen=True)
class Splits:
    train: Range
    val: Range
    test: Range
    pre_test: Range
    train_fit: Range
    val_alpha: Range
    cert: Range
    blocks: tuple[Range, ...] = ()

    def roles(self) -> dict[str, Range]:
        return {"train_fit": self.train_fit, "val_alpha": self.val_alpha, "cert": self.cert}


MONTH_HOURS = 30 * 24


def borders(kind: str, n_rows: int, lookback: int) -> tuple[Range, Range, Range]:
    """Train, validation and test rows; the later two begin with `lookback` rows of context."""
    if n_rows <= 0 or lookback <= 0:
        raise ValueError("n_rows and lookback must be positive")
    per_hour = {"ETT_hour": 1, "ETT_minute": 4}.get(kind)
    if per_hour:
        train, val, end = (m * MONTH_HOURS * per_hour for m in (12, 16, 20))
    elif kind in ("Custom", "synthetic"):
        train, end = int(n_rows * 0.7), n_rows
        val = n_rows - int(n_rows * 0.2)
    else:
        raise ValueError(f"unknown kind of dataset: {kind}")
    if train < lookback or val < lookback:
        raise ValueError("lookback is too long for the borders")
    out = Range(0, train), Range(train - lookback, val), Range(val - lookback, end)
    for r in out:
        if not r.length or r.end > n_rows:
            raise ValueError(f"{r} is empty or exceeds {n_rows} rows")
    return out


def equal_blocks(within: Range, k: int) -> tuple[Range, ...]:
    """k blocks with edges at start + length * i // k; none may be empty."""
    if k <= 0 or within.length < k:
        raise ValueError(f"{within.length} rows don't make {k} blocks")
    edges = [within.start + within.length * i // k for i in range(k + 1)]
    return tuple(Range(a, b) for a, b in zip(edges, edges[1:]))


def carve(train: Range, val: Range, test: Range, ratios=(0.6, 0.2, 0.2), k: int = 3) -> Splits:
    """Fit, alpha and certification rows before the first row of the test window, its context included."""
    if len(ratios) != 3 or min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-8:
        raise ValueError(f"ratios must be three positive numbers that sum to 1: {ratios}")
    if train.start != 0 or test.start < train.end or test.start > val.end:
        raise ValueError("the borders don't follow each other")
    pre = Range(0, test.start)
    a = int(pre.length * ratios[0])
    b = a + int(pre.length * ratios[1])
    if not 0 < a < b < pre.end:
        raise ValueError("a split is empty")
    return Splits(train, val, test, pre, Range(0, a), Range(a, b), Range(b, pre.end), equal_blocks(pre, k))


def splits_for(kind: str, n_rows: int, lookback: int, ratios=(0.6, 0.2, 0.2), k: int = 3) -> Splits:
    return carve(*borders(kind, n_rows, lookback), ratios, k)


def cert_blocks(splits: Splits, k: int) -> list[Splits]:
    """The same fit and alpha rows with each block of the certification rows."""
    r = splits.cert
    edges = [r.start + r.length * i // k for i in range(k + 1)]
    return [replace(splits, cert=Range(a, b)) for a, b in zip(edges, edges[1:]) if b > a]


def figure_splits(n: int) -> Splits:
    """Fixed shares of n rows, with 16 rows of context in front."""
    cuts = [16, int(0.45 * n), int(0.68 * n), int(0.95 * n)]
    fit, alpha, cert = (Range(a, b) for a, b in zip(cuts, cuts[1:]))
    return Splits(Range(0, cuts[3]), alpha, Range(cuts[3], n), Range(0, cuts[3]), fit, alpha, cert)


def planted_splits() -> tuple[Splits, list[Splits]]:
    """The planted panel's rows, and three forward chains with fit and alpha rows of their own."""
    def made(a, b, c, d):
        return Splits(Range(0, d), Range(b, c), Range(d, 380), Range(0, d), Range(a, b), Range(b, c), Range(c, d))

    return made(40, 170, 230, 350), [made(40, 150, 205, 250), made(40, 180, 235, 290), made(40, 210, 265, 340)]


def table(spark: SparkSession, splits: Splits) -> DataFrame:
    """(name, block, start, end) of every range."""
    rows = [(n, -1, r.start, r.end) for n, r in (("original_train", splits.train), ("original_val", splits.val), ("original_test", splits.test), ("pre_test", splits.pre_test), *splits.roles().items())]
    rows += [("stability_block", i, r.start, r.end) for i, r in enumerate(splits.blocks)]
    return spark.createDataFrame(rows, "name string, block int, start long, end long")


def role(splits: Splits, t: Column) -> Column:
    """The split that row t belongs to."""
    out = F.lit(None).cast("string")
    for name, r in splits.roles().items():
        out = F.when((t >= r.start) & (t < r.end), name).otherwise(out)
    return out


def in_blocks(rows: DataFrame, splits: Splits, k: int) -> DataFrame:
    """Certification rows tagged with their block, by a range join with the few block edges."""
    spark = rows.sparkSession
    edges = spark.createDataFrame([(i, s.cert.start, s.cert.end) for i, s in enumerate(cert_blocks(splits, k))], "block int, start long, end long")
    return rows.join(F.broadcast(edges), (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("start", "end")
