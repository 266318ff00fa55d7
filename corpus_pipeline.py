"""A training-data pipeline over ``documents``: five stages, each by one operator of ``pairlab.llm``.

A stage is a function (spark, docs, sf_dir) -> DataFrame that works on every row its predecessor kept. All but
the last return the columns of ``documents``. ``run`` writes each result as Parquet in the shared checkpoint
folder and reads it again as the next stage's input, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import bpe_rounds, decontaminate, line_dedup, quality_gbt, signature_join
from pairlab.llm.common import fresh, keep, passing, table
from pairlab.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Labels are learnt as in query op6."""
    ensure_checkpoint_dir(spark)
    seen = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = quality_gbt.fit(docs, table(spark, sf_dir, "labels"), keep=seen)
    return docs.filter(quality_gbt.quality_score(F.col("text"), model) >= quality_gbt.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their lines deduplicated over the corpus; ``n_chars`` follows the text."""
    ensure_checkpoint_dir(spark)
    left = line_dedup.dedup_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of linked documents: Jaccard similarity of 0.8 or
    more over shingles of five words. (Query op8 has its own, three words and 0.9.)"""
    ensure_checkpoint_dir(spark)
    return signature_join.keep_one(docs, size=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    ensure_checkpoint_dir(spark)
    blocks = decontaminate.benchmark_blocks(docs, table(spark, sf_dir, "benchmark"))
    (found,) = fresh(docs, "found")
    hit = docs.withColumn(found, decontaminate.contamination(F.col("text"), blocks))
    return hit.filter(F.size(F.col(found)["hits"]) == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the text decoded from them."""
    ensure_checkpoint_dir(spark)
    encoded = docs.select("doc_id", bpe_rounds.bpe_digest(spark, F.col("text"), with_ids=True).alias("d"))
    return encoded.select("doc_id", "d.n_tokens", "d.ids", "d.ids_sha256", "d.decoded_sha256")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks),
          ("tokens", tokens)]

#: The classifier has no SQL form; tests/llm compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with passing(spark):  # a stage's own tables go when its result is written
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
