"""Readers for user data (S1-S5): dictionaries, labelled pairs and test sets.

A dictionary entry is identified by its *position*. When the source carries no
id, positions follow the order of the files' names and of the rows in each file:
rows are ordered by (file, block start, place in the block) and numbered densely
(``with_global_index``: no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_global_index

_ORDER = ["_file", "_start", "_seq"]


def _placed(df: DataFrame, *cols) -> DataFrame:
    """``cols`` of a scan with each row's place in the files."""
    return df.select(*cols, F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_start"),
                     F.monotonically_increasing_id().alias("_seq"))


def _positions(df: DataFrame, out: str) -> DataFrame:
    return with_global_index(df, _ORDER, out=out).drop(*_ORDER)


def read_dictionary(spark: SparkSession, path: str, fmt: str = "text", text_col: str = "text",
                    id_col: str | None = None) -> DataFrame:
    """``corpus_id long, text string``. ``fmt='text'``: one entry per
    line, ``fmt='parquet'``: ``text_col`` plus an optional ``id_col``; without
    an id the position (files by name, rows in file order)."""
    if fmt == "text":
        return _positions(_placed(spark.read.text(path), F.col("value").alias("text")), "corpus_id") \
            .select("corpus_id", "text")
    if fmt != "parquet":
        raise ValueError("fmt must be 'text' or 'parquet'")
    df = spark.read.parquet(path)
    if id_col:
        return df.select(F.col(id_col).cast("long").alias("corpus_id"), F.col(text_col).alias("text"))
    return _positions(_placed(df, F.col(text_col).alias("text")), "corpus_id").select("corpus_id", "text")


def read_pairs(spark: SparkSession, path: str, fmt: str = "tsv", multiline: bool = False) -> DataFrame:
    """``row_id long, text1, text2, label double`` from TSV or Parquet, columns by name.

    TSV: a header names the columns (any order, more columns are ignored; files with different headers are an
    error); fields may be quoted with ``"``, doubled inside. ``multiline`` also reads quoted line breaks, at the
    price of one task per file."""
    if fmt == "tsv":
        df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', enforceSchema=False,
                            multiLine=multiline)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError("fmt must be 'tsv' or 'parquet'")
    lost = [c for c in ("text1", "text2", "label") if c not in df.columns]
    if lost:
        raise ValueError(f"no column(s) {lost} in {path}; found {df.columns}")
    placed = _placed(df, "text1", "text2", F.col("label").cast("double").alias("label"))
    return _positions(placed, "row_id").select("row_id", "text1", "text2", "label")


def read_testset(spark: SparkSession, path: str, fmt: str = "nested") -> DataFrame:
    """``query_id long, query string, labels array<string>``.

    ``nested``: Parquet with ``query`` and ``labels array<string>`` (order =
    query id). ``long``: Parquet with one ``query, label`` row per label; the
    labels of a query are gathered with ``collect_list`` (one group per
    query, bounded by that query's labels) and queries are numbered by their
    first appearance."""
    df = spark.read.parquet(path)
    if fmt == "nested":
        rows = _placed(df, "query", F.col("labels").cast("array<string>").alias("labels"))
        return _positions(rows, "query_id").select("query_id", "query", "labels")
    if fmt != "long":
        raise ValueError("fmt must be 'nested' or 'long'")
    rows = _placed(df, "query", F.col("label").cast("string").alias("label"))
    place = F.struct(*_ORDER)
    grouped = rows.groupBy("query").agg(
        F.min(place).alias("_first"),
        F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "label"))), lambda s: s["label"])
        .alias("labels"))
    return with_global_index(grouped, ["_first"], out="query_id").select("query_id", "query", "labels")
