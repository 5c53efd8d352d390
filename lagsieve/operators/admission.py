"""From p-values to admitted edges: false discovery control, stability, admission, and views of the result. Catalyst only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .probe import is_finite

Q, LEAST_B, LEAST_FRACTION = 0.1, 200, 0.60


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def benjamini_hochberg(edges: DataFrame, q: float = Q, *, per: tuple[str, ...] = (), least_B: int = LEAST_B) -> DataFrame:
    """With fdr_q, fdr_pass, fdr_underpowered: step-up over the finite p-values of each group (all rows without `per`), ties with the cutoff included.

    Equal p-values are counted before they are ranked, so a group's ranking
    holds one row a distinct value: at most the lattice of B + 1 values.
    """
    if not 0 < q <= 1 or least_B < 1:
        raise ValueError("q must be in (0, 1] and least_B positive")
    require(edges, "p_value", "certified_candidate", *per)
    p = F.expr("try_cast(p_value AS double)")
    rows = edges.withColumn("_p", F.when(is_finite(p), p))
    keys = [F.col(c) for c in per] or [F.lit(0)]
    values = rows.where("_p IS NOT NULL").groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], "_p").agg(F.count("*").alias("n"))
    names = [f"_k{i}" for i in range(len(keys))]
    within = W.partitionBy(*names)
    counted = values.withColumn("rank", F.sum("n").over(within.orderBy("_p").rowsBetween(W.unboundedPreceding, 0))).withColumn("m", F.sum("n").over(within))
    passing = F.col("_p") <= F.col("rank").cast("double") / F.col("m").cast("double") * F.lit(float(q))
    cutoffs = counted.where(passing).groupBy(*names).agg(F.max("_p").alias("_cutoff"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & k.eqNullSafe(F.col(f"_k{i}")) if per else F.col("_k0") == 0
    out = rows.join(cutoffs, match, "left") if per else rows.join(F.broadcast(cutoffs), F.lit(0) == F.col("_k0"), "left")
    under = (F.coalesce(F.expr("try_cast(B AS double)"), F.lit(float("-inf"))) < least_B) if "B" in edges.columns else F.lit(False)
    reject = F.coalesce(F.col("_p") <= F.col("_cutoff"), F.lit(False))
    return out.select(*edges.columns, F.lit(float(q)).alias("fdr_q"), (reject & flag("certified_candidate")).alias("fdr_pass"), under.alias("fdr_underpowered"))


def stability(full: DataFrame, blocks: DataFrame, k: int, least: float = LEAST_FRACTION, keys: tuple[str, ...] = ("target", "source")) -> DataFrame:
    """With stability_fraction, _pass, _k, _min_fraction: the share of k blocks in which the edge is a candidate. blocks: one table with a column `block`."""
    if not 0 <= least <= 1 or not keys:
        raise ValueError("least must be in [0, 1] and keys not empty")
    require(full, *keys, "certified_candidate")
    require(blocks, *keys, "certified_candidate", "block")
    seen = blocks.where(flag("certified_candidate")).select(*keys, "block").distinct().groupBy(*keys).agg(F.count("*").alias("_n"))
    fraction = (F.coalesce("_n", F.lit(0)) / F.lit(float(k))) if k else F.lit(0.0)
    out = full.join(seen, list(keys), "left")
    return out.select(*full.columns, fraction.alias("stability_fraction"), (F.lit(k > 0) & (fraction >= F.lit(float(least)))).alias("stability_pass"), F.lit(k).alias("stability_k"), F.lit(float(least)).alias("stability_min_fraction"))


def admit(edges: DataFrame, *, candidate: bool = True, fdr: bool = True, stable: bool = True) -> DataFrame:
    """With e_certified: all the flags asked for; a null flag is false."""
    flags = [n for n, on in (("certified_candidate", candidate), ("fdr_pass", fdr), ("stability_pass", stable)) if on]
    require(edges, *flags)
    out = F.lit(True)
    for n in flags:
        out = out & flag(n)
    return edges.withColumn("e_certified", out)


def summary(edges: DataFrame) -> DataFrame:
    """Counts of every flag there is, in one row."""
    flags = [c for c in ("certified_candidate", "fdr_pass", "stability_pass", "e_certified", "fdr_underpowered") if c in edges.columns]
    return edges.agg(F.count("*").alias("n_edges"), F.count_if(is_finite(F.col("p_value"))).alias("n_finite_p"), *[F.count_if(flag(c)).alias(f"n_{c}") for c in flags])


def adjacency(edges: DataFrame, n: int, value: str = "aligned_gain") -> DataFrame:
    """target and columns s0 ... s(n - 1): certified edges' values, 0 elsewhere, a row for each of n targets."""
    grid = edges.sparkSession.range(n).select(F.col("id").cast("int").alias("target"))
    made = edges.where(flag("e_certified")).groupBy("target").pivot("source", list(range(n))).agg(F.first(value))
    out = grid.join(made, "target", "left")
    return out.select("target", *[F.coalesce(F.col(f"`{j}`"), F.lit(0.0)).alias(f"s{j}") for j in range(n)])


def recall_curve(screened: DataFrame, certified: DataFrame, most: int) -> DataFrame:
    """(m, kept, total, recall, reduction): certified edges that a screen of top m keeps, for m up to `most`."""
    rows = screened.select("target", "source", "screen_rank").join(certified.select("target", "source", flag("e_certified").alias("hit")), ["target", "source"], "left")
    by = rows.groupBy("screen_rank").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"), F.count("*").alias("n"))
    m = screened.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("m"))
    # as many rows as ranks: running sums over them
    upto, whole = W.orderBy(F.asc_nulls_last("m")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    ranks = m.join(by.select(F.col("screen_rank").cast("int").alias("m"), "hits", "n"), "m", "full").fillna(0, ["hits", "n"])
    out = ranks.select("m", F.sum("hits").over(upto).alias("kept"), F.sum("hits").over(whole).alias("total"), F.sum("n").over(upto).alias("probed"), F.sum("n").over(whole).alias("pairs")).where((F.col("m") <= most) & (F.col("pairs") > 0))
    return out.select("m", "kept", "total", F.when(F.col("total") > 0, F.col("kept") / F.col("total")).otherwise(F.lit(float("nan"))).alias("recall"), (1 - F.col("probed") / F.col("pairs")).alias("reduction"))
