"""A training corpus in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's
documents. All but the last return the columns of ``documents``, whatever other columns the table has.

Defined results: without labels the quality rules have their default limits; null and empty texts fail the quality rules; rows with a null id pass every stage on their own text and are never removed as a
copy of another row; of rows with one id that the quality rules keep, one stays, that whose text (then language, source, count) sorts first; a
document left without a word by the substring stage goes; empty tables give no rows. ``materialize.release`` frees the tables that a run has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.llm import bpe, decontaminate, minhash, quality, substring
from siteloom.plans.materialize import materialize, release, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject, with limits fitted on documents labelled good."""
    docs = docs.select(*COLUMNS)
    limits = quality.fit_limits(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("quality") == 1)
    return quality.keep_good(docs, limits=limits)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    marks = found.where("doc is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
    marks = materialize(marks, "marks", found.count())
    once = docs.join(marks, "doc_id", "left_anti")
    # Ids are repeated by mistake only, so the texts of these few rows are compared, not those of all.
    repeated = docs.join(marks.where("kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("first")).select("doc_id", "first.*")
    return once.unionByName(repeated.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines and passages; a document left without a word goes. n_chars follows the text."""
    cut = substring.dedup(docs.select(*COLUMNS))
    changed = F.size("removed") > 0
    empty = changed & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return cut.where(~F.coalesce(empty, F.lit(False))).select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.keep_clean(docs.select(*COLUMNS), items)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and digests of them and of the text decoded from them."""
    coded = bpe.round_trip(docs.select("doc_id", "text"))
    return bpe.digests(coded, ["doc_id", "ids"])


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Compression ratios, min-max signatures and token merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage needed is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = written(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, [t for t in written(spark)[:-1] if t not in others])
    return STAGES[-1][1](spark, docs, sf_dir)
