"""Approximate nearest neighbours by inner product with a hash-prefix forest.

A tree is the sorted array of the points' hash strings: 32 sign bits of random projections, after points are
given one more coordinate that makes all their norms equal, so that a larger inner product is a smaller angle.
A query descends each tree by binary search to its longest common prefix, then all trees are ascended together,
one bit less at a time, until the ranges of points sharing the prefix hold ``share`` times as many entries as
the block has points. Candidates are scored exactly, in double precision, on the original vectors.

``share`` and ``trees`` are set for the hardest data, unclustered vectors (see the README for measured recall):
a query then scores about a third of the points.

Every row is indexed. Equal vectors are one point, with its ``k + 1`` smallest ids (no other id of a point can
be among the k nearest, ties going to the smaller id). Points are cut into blocks by a hash of their id, and
queries likewise; each (point block, query block) is one bounded task that builds its part of the forest and
returns its best for each query, and a top-k per query joins the blocks.

Results for odd input: vectors that are null, empty, all zero, or hold a null or non-finite component take no
part, nor do those whose length is not the most frequent one (ties: the longer); a null id takes no part; an
id given twice is the row with the smaller vector; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

TREES = 128
SHARE = 0.45            # entries gathered over all trees, for each point of the block
LEAST = 2_000           # entries gathered at least
BLOCK_BYTES = 24 << 20  # vectors of one block of points
QUERY_ROWS = 16_384     # queries of one block at most
_SEED, _BITS = 20_011, 32
_FOUND = "query long, point long, score double"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("vector").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


class Forest:
    """The trees over one block of points."""

    def __init__(self, points: np.ndarray, trees: int):
        norms = np.einsum("ij,ij->i", points, points)
        rest = np.sqrt(np.maximum(norms.max() - norms, 0))
        rng = np.random.default_rng(_SEED)
        self.planes = [rng.standard_normal((points.shape[1] + 1, _BITS)) for _ in range(trees)]
        self.points, self.order, self.keys = points, [], []
        for plane in self.planes:
            key = self._hash(points, plane) if not rest.any() else self._hash(np.column_stack([points, rest]), plane)
            order = np.argsort(key, kind="stable")
            self.order.append(order.astype(np.int32))
            self.keys.append(key[order])

    @staticmethod
    def _hash(rows: np.ndarray, plane: np.ndarray) -> np.ndarray:
        bits = rows @ plane[:rows.shape[1]] > 0
        return np.packbits(bits, axis=1).view(">u4").ravel().astype(np.uint32)

    def ranges(self, queries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of points sharing the longest prefix with which all trees
        together hold ``least`` entries. (Entries grow as the prefix shrinks, so its length is found by
        bisection instead of one step at a time.)"""
        keys = [self._hash(queries, plane) for plane in self.planes]

        def at(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            free = (np.uint64(1) << (np.uint64(_BITS) - length.astype(np.uint64))) - np.uint64(1)
            free = free.astype(np.uint32)  # the bits below the prefix
            low = [np.searchsorted(t, k & ~free, "left") for t, k in zip(self.keys, keys)]
            high = [np.searchsorted(t, k | free, "right") for t, k in zip(self.keys, keys)]
            return np.array(low), np.array(high)
        short, long = np.zeros(len(queries), np.int64), np.full(len(queries), _BITS + 1, np.int64)
        while (long - short > 1).any():  # enough entries at short (or it is 0), not at long
            middle = (short + long) // 2
            low, high = at(middle)
            enough = (high - low).sum(axis=0) >= least
            short, long = np.where(enough, middle, short), np.where(enough, long, middle)
        return at(short)

    def search(self, queries: np.ndarray, k: int, least: int):
        """For each query (row numbers of its best points, their scores)."""
        low, high = self.ranges(queries, least)
        for i, query in enumerate(queries):
            seen = np.zeros(len(self.points), bool)
            for order, a, b in zip(self.order, low[:, i], high[:, i]):
                seen[order[a:b]] = True
            rows = np.flatnonzero(seen)
            scores = np.einsum("ij,j->i", self.points[rows], query)
            if len(rows) > k:
                kth = np.partition(scores, len(rows) - k)[len(rows) - k]
                rows, scores = rows[scores >= kth], scores[scores >= kth]  # ties stay
            yield rows, scores


def _search_block(k: int, trees: int, share: float, least: int):
    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not points.num_rows or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        ids = points.column("point").to_numpy()
        order = np.argsort(ids)
        forest, asked = Forest(_matrix(points)[order], trees), queries.column("point").to_numpy()
        ids, found = ids[order], list(forest.search(_matrix(queries), k, max(least, int(share * len(ids)))))
        return pa.table({"query": np.repeat(asked, [len(r) for r, _ in found]),
                         "point": ids[np.concatenate([r for r, _ in found])],
                         "score": np.concatenate([s for _, s in found])})
    return search


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, share: float = SHARE, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query row, its own row left out."""
    require(rows, id_col, vector)
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"),
                        F.coalesce(is_query, F.lit(False)).alias("asked"))
    given = given.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    given = given.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked"))
    given = written(given)
    sizes = given.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return given.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                            F.lit(0.0).alias("score")).limit(0)
    dim, n = sizes["d"], sizes["count"]
    given = given.filter(F.size("vector") == dim)
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    ids = given.select("id", "vector", place.alias("place")).filter(F.col("place") <= k + 1)
    points = ids.groupBy("vector").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = written(points.select("point", "ids", "vector"))
    asked = written(given.filter("asked").join(points.select("point", F.col("vector").alias("same")),
                                               F.col("vector") == F.col("same")).select("id", "point", "vector"))
    queries = asked.groupBy("point").agg(F.first("vector").alias("vector"))
    n_blocks = max(1, math.ceil(n * dim * 8 / block_bytes))
    n_queries = queries.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    q_blocks = max(1, math.ceil(n_queries / QUERY_ROWS), min(math.ceil(tasks / n_blocks), n_queries // 1024))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod(F.xxhash64("point"), F.lit(count)).cast("int")
    left = points.select("point", "vector", block(n_blocks).alias("b"), every(q_blocks).alias("q"))
    right = queries.select("point", "vector", block(q_blocks).alias("q"), every(n_blocks).alias("b"))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(
        _search_block(k + 1, trees, share, least), _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = top.join(points.select("point", "ids"), "point").groupBy("query").agg(
        F.collect_list(F.struct("score", "ids")).alias("found"))
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(
        (-f["score"]).alias("minus"), i.alias("id")))))
    ranked = asked.select("id", F.col("point").alias("query")).join(
        lists.select("query", F.sort_array(flat).alias("near")), "query")
    kept = ranked.select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return kept.select(F.col("id").alias("query_id"), F.posexplode("near").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
