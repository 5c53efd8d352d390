"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and returns the columns of documents; the last returns the pieces.

1. toxicity: documents with a score of 0.7 or more go. The models learn from
   the table `labels`, as far as its documents are there.
2. ngram_jaccard: of documents linked by shingle sets, directly or through
   others, the one with the smallest doc_id stays. Rows that share a doc_id are
   one document: all its different texts stay, equal ones once.
3. decontamination: documents that hold a test item of `benchmark` go.
4. secret_scan: every span of a secret becomes `REDACTED`; n_chars follows.
   No document goes.
5. packing: what is left becomes sequences of at most 2048 tokens.

Rows without a doc_id pass stage 2, where nothing is known of them; in the
others each is judged by its text. Null and empty texts pass all stages and are
one piece of one id in the last. Ties: equal texts, wherever they stand, get
equal scores and spans, and the smallest doc_id stays. Very long texts are
worked on whole. Other columns are carried along whatever their names (the last
stage returns its own). Empty tables pass all stages.
The models and the packing can't be stated in SQL, so ORACLE_SQL is None; the
tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagsieve.llm import decontamination, ngram_jaccard, packing, runtime, secret_scan, toxicity

REDACTED = "[REDACTED]"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(docs, runtime.table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("kept.*")


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = runtime.written(ngram_jaccard.jaccard_components(docs), "groups")
    # texts stay where they are: the ids to leave out go to them (by broadcast if they are few)
    gone = runtime.written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = docs.join(decontamination.small(gone), docs.doc_id == gone._gone, "left_anti")
    again = runtime.written(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "again")
    if again.isEmpty():
        return kept
    again = decontamination.small(again)
    once = kept.join(again, kept.doc_id == again._again, "left_anti")
    return once.unionByName(kept.join(again, kept.doc_id == again._again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(docs, runtime.table(spark, sf_dir, "benchmark"))
    leaked = runtime.written(found.select(F.col("doc_id").alias("_leaked"), *[F.when(F.col("doc_id").isNull(), F.col(t)).alias(f"_{t}") for t in ("t1", "t2")]).distinct(), "leaked")
    named = decontamination.small(leaked.where("_leaked IS NOT NULL"))
    kept = docs.join(named, docs["doc_id"] == named["_leaked"], "left_anti")
    nameless = leaked.where("_leaked IS NULL")
    if nameless.isEmpty():
        return kept
    # a row without an id is known by its text
    t1, t2 = decontamination.text_hashes("text").values()
    nameless = decontamination.small(nameless)
    return kept.join(nameless, F.col("doc_id").isNull() & (t1 == nameless["_t1"]) & (t2 == nameless["_t2"]), "left_anti")


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(docs, keep=tuple(docs.columns), redact=REDACTED)
    columns = {c: F.col(f"kept.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        length = F.length("kept.text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(columns["n_chars"])
    return out.select(*[v.alias(c) for c, v in columns.items()])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = runtime.written(stage(spark, docs, sf_dir), f"stage-{name}")
        runtime.sweep(spark, keep=docs)
    return docs
