"""A training corpus from ``documents``: toxic texts out, one of each near-duplicate group kept,
benchmark leaks out, secrets masked, and the rest encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import bpe, decontaminate, jaccard_join, queries, secret_scan, toxicity
from metricloom.sources.scratch import dropped, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under the limit; null and empty texts stay.

    Columns other than ``COLUMNS`` are left out, here and in the later stages,
    whatever their names. An empty table stays empty.
    """
    index = queries.toxicity_index(spark, sf_dir)
    return toxicity.with_toxicity(docs.select(COLUMNS), index).where(F.col("score") < queries.TOXIC).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are alike in 0.8 or more of their five-word shingles.

    The row with the group's least doc_id stays, of several the one of least
    digest; a row that repeats another's doc_id and text is its copy. Rows
    without words are linked with nothing and stay.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    # A key is never null itself, and keys of equal digests and null doc_ids are equal:
    # texts are dealt by it once, for the join and for the copies.
    tagged = docs.select(*COLUMNS, F.struct("doc_id", digest.alias("digest")).alias("key"))
    groups = jaccard_join.jaccard_components(tagged, "key", "text", shingle=5, threshold=80)
    kept = groups.where("component_id <=> key").select("key")
    return tagged.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null and empty texts hold none and stay."""
    docs = docs.select(COLUMNS)
    digest = F.sha2("text", 256)
    leaks = decontaminate.find_leaks(
        docs.select(digest.alias("digest"), "text"), queries.table(spark, sf_dir, "benchmark"), key="digest"
    )
    return docs.join(leaks.select("digest").distinct(), digest == F.col("digest"), "left_anti").select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced by a mark and ``n_chars`` counted anew where there were any."""
    masked = secret_scan.redact_secrets(docs.select(*COLUMNS, F.length("text").alias("before")))
    changed = F.length("text") - F.col("before")
    return masked.withColumn("n_chars", F.col("n_chars") + F.coalesce(changed, F.lit(0))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, decoded_sha256)`` of every row; a null text is an empty one."""
    done = bpe.encode_decode(docs, queries.vocabulary("word_bpe_49k.json"))
    return done.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in place of the one before."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
