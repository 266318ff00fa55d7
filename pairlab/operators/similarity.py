"""Similarity joins: cosine top-k (J1, W2, P5, P11), thresholded edges
(J2, J3), aligned-pair cosine (J4) and its first-row compat form (J5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_rows
from .blocks import KernelSpec, PackedTargets, similarity_kernel


def vector_lookup(dictionary: DataFrame) -> DataFrame:
    """text -> embedding, one row per distinct text (first position wins).

    ``min_by`` is a partial aggregate, so a text repeated across a large part
    of the dictionary is combined map-side, not collected into one task."""
    return dictionary.groupBy("text").agg(
        F.min_by("embedding", "corpus_id").alias("embedding"))


def first_position(dictionary: DataFrame) -> DataFrame:
    """Text -> first corpus_id holding it (``list.index``)."""
    return dictionary.groupBy("text").agg(F.min("corpus_id").alias("corpus_id"))


def top_k_join(queries: DataFrame, candidates: DataFrame | PackedTargets, k: int = 5,
               threshold: float = 0.0, key: str = "query_id",
               return_scores: bool = True, **kernel_opts) -> DataFrame:
    """For every query row the ``k`` most similar candidates with
    ``score > threshold``, ranked by score desc then corpus_id asc.

    ``queries``: ``<key>, embedding``; ``candidates``: ``corpus_id, text,
    embedding``, or ``blocks.packed_targets`` of them. Returns ``<key>, rank, corpus_id, text[, score]``."""
    left = queries.select(F.col(key).alias("key"), F.col("embedding").alias("vec"))
    if "left_spread" not in kernel_opts and getattr(queries, "_pairlab_materialized", False):
        spark = queries.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        kernel_opts["left_spread"] = queries.rdd.getNumPartitions() >= parts   # cheap: materialized
    res = similarity_kernel(left, candidates, KernelSpec(mode="rank", n=k, above=threshold, counts=False),
                            **kernel_opts)
    hits = res.select(F.col("key").alias(key),
                      F.posexplode(F.arrays_zip("ids", "texts", "raw")).alias("pos", "e"))
    cols = [key, (F.col("pos") + 1).alias("rank"), F.col("e.ids").alias("corpus_id"),
            F.col("e.texts").alias("text")]
    if return_scores:
        cols.append(F.col("e.raw").alias("score"))
    return hits.select(*cols)


def nest_hits(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Long hits -> one row per query with ``array<struct<text, score>>`` in rank order."""
    return hits.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text", "score"))),
        lambda s: F.struct(s["text"].alias("text"), s["score"].alias("score"))).alias("hits"))


def similarity_edges(left: DataFrame, targets: DataFrame, min_score: float,
                     clamp: bool = True, **kernel_opts) -> DataFrame:
    """All (row, target) pairs whose (clamped) score is >= min_score,
    skipping targets whose text equals the row's excluded text.

    ``left``: ``key, vec[, xh, xt, anchor]``; rows of one ``anchor`` (see ``by_anchor``) are scored once.
    Returns ``key, target_id, text, raw``."""
    return similarity_kernel(left, targets, KernelSpec(mode="edges", clamp=clamp,
                                                       min_score=min_score), **kernel_opts)


ANCHOR_ROWS = 2048   # rows of an anchor in one partition


def by_anchor(rows: DataFrame, col: str, row: str, parts: int) -> DataFrame:
    """``rows`` dealt so that those with one text in ``col`` lie together (column ``anchor``: its hash), at most about
    ``ANCHOR_ROWS`` of them in a partition: the few texts with more rows are dealt to several. The table of
    those, one row for every ``ANCHOR_ROWS`` rows at most, is small against the rows and joined by text."""
    anchored = rows.withColumn("anchor", F.xxhash64(col))
    hot = anchored.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ANCHOR_ROWS)
    share = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(float(ANCHOR_ROWS)))
    spread = anchored.join(hot, "anchor", "left").withColumn("_part", F.pmod(F.xxhash64(row), share))
    return spread.repartition(parts, "anchor", "_part").drop("_n", "_part")


def with_vectors(df: DataFrame, text_col: str, dictionary: DataFrame, out: str, encoder=None) -> DataFrame:
    """``df`` with the vector of ``text_col`` in column ``out``: the dictionary's first entry of that text or,
    with an ``encoder`` (column -> array<double>), for any other text its encoding, each distinct text once.
    Without an encoder an unknown text has a null vector. Rows are neither lost nor multiplied."""
    known = vector_lookup(dictionary).select(F.col("text").alias(text_col), F.col("embedding").alias(out))
    joined = df.join(known, text_col, "left")
    if encoder is None:
        return joined
    texts = df.select(text_col).filter(F.col(text_col).isNotNull()).distinct()
    new = texts.join(known.select(text_col), text_col, "left_anti")
    new = new.select(text_col, encoder(F.col(text_col)).alias("_new"))
    return joined.join(new, text_col, "left").withColumn(out, F.coalesce(out, "_new")).drop("_new")


def pair_cosine(pairs: DataFrame, left_vectors: DataFrame, right_vectors: DataFrame,
                left_text: str = "text1", right_text: str = "text2",
                out: str = "score", encoder=None) -> DataFrame:
    """Cosine of each aligned (text1, text2) pair, one row per pair; null where a text has no vector."""
    v = with_vectors(pairs, left_text, left_vectors, "_lv", encoder)
    v = with_vectors(v, right_text, right_vectors, "_rv", encoder)
    return v.withColumn(out, cosine_rows(F.col("_lv"), F.col("_rv"))).drop("_lv", "_rv")


def first_row_cosine(pairs: DataFrame, left_vectors: DataFrame, right_vectors: DataFrame,
                     order_col: str = "row_id", left_text: str = "text1",
                     right_text: str = "text2", out: str = "score", encoder=None) -> DataFrame:
    """J5 (compat): cos(text1 of the first row, text2 of every row).

    The first row's vector is a scalar subquery (one value, computed once and
    shipped with the plan), so no row is joined to a constant key."""
    first = pairs.agg(F.min_by(left_text, order_col).alias(left_text))
    first_vec = with_vectors(first, left_text, left_vectors, "_lv", encoder).select("_lv").scalar()
    v = with_vectors(pairs, right_text, right_vectors, "_rv", encoder)
    return v.withColumn(out, cosine_rows(first_vec, F.col("_rv"))).drop("_rv")
