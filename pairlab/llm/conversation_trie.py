"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns (role, text); conversations that start with it are its members.

1. Every turn has two 64-bit digests of its place, role and text; a prefix has the exclusive or of its turns' (a
   running value over blocks of ``BLOCK`` turns plus the blocks before, so no conversation is held by one task). A
   third digest of the last turn and the parent is kept beside: all occurrences of a node must agree in it,
   else everything is done again with other digests.
2. Occurrences (conversation, depth) are aggregated to nodes: members, smallest member, and the turns that members
   still have, which bound the subtree's nodes. This combines before it shuffles, so hot prefixes cost no more.
3. Nodes whose bound is above ``SHARD_TURNS`` are the top of the trie. Below, each subtree is whole and small;
   subtrees are dealt to shards. A shard enumerates its digests in a minimal perfect hash (levels of bits; a key that
   is alone at its bit has its slot there) and keeps digests, counts and parents in flat arrays by slot. A looked-up
   slot counts only if the digests kept there are equal. Children, leaves and savings are added to parent slots level
   by level, deepest first.
4. The shards' roots are added up by parent, and the top is one more such table. If even the top has more nodes than
   a shard may have, its deepest levels are added up by Spark, level by level, until it has not.
5. The ids of conversations that end at a node are sorted over all tasks, joined to texts piece by piece, and the
   pieces of a node are hashed one after another, never together.

Results for odd input: null roles and texts are empty; turns with the same number are ordered by role, then text, and
repeated rows are turns of their own; rows without a conversation id belong to no conversation; conversations
without turns are members of the root only; without conversations there is no node, not even a root; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_global_index
from .common import require, written
from .tokens import chain, mix

SHARD_TURNS = 100_000   # nodes of a subtree that one task holds
BLOCK = 1024            # turns of a running digest
PIECE_IDS = 1024        # ids joined to one text
SENT_NODES = 200_000    # top nodes that are broadcast (8 MB); beyond, they are joined by shuffle
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- turns
def numbered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """conv, pos (from 0), role, text: the turns of each conversation in order of turn (null first)."""
    require(rows, conv, turn, role, text)
    given = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"))
    placed = written(with_global_index(given, ["conv", "turn", "role", "text"], out="place"))
    first = placed.groupBy("conv").agg(F.min("place").alias("first"))
    return placed.join(first, "conv").select("conv", (F.col("place") - F.col("first")).alias("pos"), "role", "text")


def graft(turns: DataFrame, trunk, length) -> tuple[DataFrame, DataFrame]:
    """Every conversation anew: the first ``length`` turns of conversation ``trunk`` (all if it has fewer, none if it
    does not exist), then its own after its first ``length``. ``trunk`` and ``length`` (at most 8): columns of conv.
    Returns the turns and the conversations (conv), also those without turns."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    plan = convs.select("conv", trunk.alias("trunk"), length.cast("long").alias("h"))
    sizes = convs.select(F.col("conv").alias("trunk"), "n")
    plan = written(plan.join(sizes, "trunk", "left").select(
        "conv", "trunk", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("m")))
    starts = turns.filter("pos < 8").withColumnRenamed("conv", "trunk")
    heads = plan.select("conv", "trunk", "h").join(starts, "trunk").filter("pos < h").select(
        "conv", "pos", "role", "text")
    tails = turns.join(plan.select("conv", "h", "m"), "conv").filter("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "role", "text")
    return heads.unionByName(tails), plan.select("conv")


# ---------------------------------------------------------------- prefixes
def _occurrences(turns: DataFrame, convs: DataFrame, salt: int) -> DataFrame:
    """conv, depth, a, b (digests of the prefix), pa, pb (its parent's), check, bytes, size (turns of conv)."""
    sha = F.sha2(F.concat_ws(":", "pos", F.length("role"), "role", "text"), 256)
    own = turns.select("conv", "pos", F.octet_length("text").cast("long").alias("bytes"), sha.alias("sha"))
    own = own.select("conv", "pos", "bytes", F.floor(F.col("pos") / BLOCK).alias("block"), *[
        F.xxhash64(F.lit(3 * salt + i), "sha").alias(x) for i, x in enumerate(("x", "y", "z"))])
    blocks = own.groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv", "block", F.bit_xor("x").over(before).alias("cx"),
                            F.bit_xor("y").over(before).alias("cy")).filter("block > 0")
    within = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumns({"a": F.bit_xor("x").over(within), "b": F.bit_xor("y").over(within)})
    run = run.join(carried, ["conv", "block"], "left").withColumns({
        "a": F.col("a").bitwiseXOR(F.coalesce("cx", F.lit(0))), "b": F.col("b").bitwiseXOR(F.coalesce("cy", F.lit(0)))})
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    deep = run.join(sizes, "conv").select(
        "conv", (F.col("pos") + 1).alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"),
        F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "z", "bytes", "size")
    deep = deep.withColumn("check", F.xxhash64("depth", "pa", "pb", "z")).drop("z")
    zero = F.lit(0).cast("long")
    roots = convs.join(sizes, "conv", "left").select(
        "conv", zero.alias("depth"), *[zero.alias(x) for x in ("a", "b", "pa", "pb", "bytes")],
        F.coalesce("size", zero).alias("size"), zero.alias("check"))
    return deep.unionByName(roots)


def _nodes(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("a", "b").agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("bound"),
        (F.min("check") != F.max("check")).alias("mixed"))


# ---------------------------------------------------------------- node tables
class PerfectHash:
    """Slots 0 ... n - 1 of n distinct keys (pairs of 64-bit numbers), as levels of bits."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # ranks of the bits, by bit
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        left, used = np.arange(len(a)), 0
        while len(left):
            size = 2 * len(left) + 1
            at = self._place(a[left], b[left], len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            self.levels.append((bits, used + np.cumsum(bits) - 1))
            used += int(bits.sum())
            left = left[~bits[at]]
        slot = self._slots(a, b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (chain(mix(a + np.uint64(level)), b) % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._place(a[left], b[left], level, len(bits))
            out[left[bits[at]]] = rank[at[bits[at]]]
            left = left[~bits[at]]
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in the table (the kept keys decide)."""
        out = self._slots(a, b)
        there = out >= 0
        there[there] = (self.a[out[there]] == a[there]) & (self.b[out[there]] == b[there])
        return np.where(there, out, -1)


_SUMS = ["n_children", "n_leaves", "saved_tokens"]
_NODE = ["a", "b", "pa", "pb", "conv", "depth", "n_convs"]
_DONE = ", ".join(f"{c} long" for c in [*_NODE, "parent", *_SUMS])


def _accumulate(table: pa.Table) -> pa.Table:
    """Sums over subtrees of the nodes of a table; ``_SUMS`` hold what children elsewhere have added so far."""
    given = {c: table.column(c).to_numpy() for c in [*_NODE, "bytes", *_SUMS]}
    a, b = given["a"].view(np.uint64), given["b"].view(np.uint64)
    names = PerfectHash(a, b)
    slot = names.slots(a, b)
    cols = {c: np.zeros(len(slot), np.int64) for c in given}
    for c, values in given.items():
        cols[c][slot] = values
    up = names.slots(cols["pa"].view(np.uint64), cols["pb"].view(np.uint64))
    up[cols["depth"] == 0] = -1
    children, leaves, saved = (cols[c] for c in _SUMS)
    saved += (cols["n_convs"] - 1) * cols["bytes"]
    order = np.argsort(-cols["depth"], kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(cols["depth"][order])) + 1):
        leaves[level] += children[level] == 0
        inner = level[up[level] >= 0]
        np.add.at(children, up[inner], 1)
        np.add.at(leaves, up[inner], leaves[inner])
        np.add.at(saved, up[inner], saved[inner])
    out = {c: cols[c] for c in _NODE}
    out["parent"] = pa.array(cols["conv"][up], mask=up < 0) if len(up) else pa.array([], pa.int64())
    return pa.table(out | {c: cols[c] for c in _SUMS})


def _sums_by_parent(done: DataFrame) -> DataFrame:
    return done.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                                        F.sum("saved_tokens").alias("saved_tokens")).select(
        F.col("pa").alias("a"), F.col("pb").alias("b"), *_SUMS)


def _added(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """``nodes`` with what ``sums`` (by a, b) adds to them."""
    more = sums.select("a", "b", *[F.col(c).alias(f"more_{c}") for c in _SUMS])
    return nodes.join(more, ["a", "b"], "left").withColumns(
        {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in _SUMS}).drop(*[f"more_{c}" for c in _SUMS])


def _top_sums(top: DataFrame, limit: int) -> DataFrame:
    """Sums of the top's nodes; level by level from below while they are too many for one table."""
    done = []
    while top.count() > limit:
        deepest = top.agg(F.max("depth")).first()[0]
        if deepest == 0:
            break
        low = top.filter(F.col("depth") == deepest).withColumns({
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")})
        low = written(low.select(*_NODE, F.lit(None).cast("long").alias("parent"), *_SUMS))
        done.append(low)
        top = written(_added(top.filter(F.col("depth") < deepest), _sums_by_parent(low)))
    out = top.groupBy(F.lit(0).alias("table")).applyInArrow(_accumulate, _DONE)
    for low in done:
        out = out.unionByName(low)
    return out


# ---------------------------------------------------------------- ends
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node, joined; rows are sorted by node and id."""
    for batch in batches:
        a, b, ids = (batch.column(i).to_numpy() for i in range(3))
        if not len(ids):
            continue
        cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        cuts = np.unique(np.concatenate([[0], cut, np.arange(0, len(ids), PIECE_IDS), [len(ids)]]))
        texts = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c[cuts[:-1]]) for c in (a, b, ids)] + [pa.array(texts, pa.string())],
                                         ["a", "b", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's pieces; rows are sorted by node and first id."""
    now, sha = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if (a, b) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_buffer())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), r)) for r in out])
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"a": now[0], "b": now[1], "ends_sha256": sha.hexdigest()}])


def _ends(occurrences: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of nodes at which conversations end."""
    parts = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = occurrences.filter("depth = size").select("a", "b", "conv")
    pieces = ends.repartitionByRange(parts, "a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(
        _pieces, "a long, b long, first long, ids string")
    return pieces.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(
        _hashed, "a long, b long, ends_sha256 string")


# ---------------------------------------------------------------- the trie
def prefix_trie(turns: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS,
                sent_nodes: int = SENT_NODES) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members beyond the first times bytes of the last text) and ends_sha256.

    ``turns``: conv, pos (from 0, without gaps), role, text. ``convs``: conv, each once."""
    salt = 0
    while True:
        occurrences = written(_occurrences(turns, convs, salt))
        nodes = written(_nodes(occurrences))
        if nodes.filter("mixed").isEmpty():
            break
        salt += 1  # two prefixes had one digest
    nodes = nodes.select(*_NODE, "bytes", "bound", *[F.lit(0).cast("long").alias(c) for c in _SUMS])
    top = written(nodes.filter(F.col("bound") > shard_turns))
    n_top = top.count()
    low = nodes.filter(F.col("bound") <= shard_turns)
    send = F.broadcast if n_top <= sent_nodes else (lambda df: df)
    if n_top:
        # members of the top are a prefix of each path: the first node below is the root of its subtree
        above = occurrences.join(send(top.select("a", "b")), ["a", "b"], "left_semi")
        above = above.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"))
        roots = occurrences.join(above, ["conv", "depth"]).select(
            "conv", F.col("a").alias("ra"), F.col("b").alias("rb"))
        low = low.join(roots, "conv")
    else:
        low = low.withColumns({"ra": F.lit(0), "rb": F.lit(0)})
    shards = max(1, math.ceil(nodes.count() / shard_turns))
    low = low.groupBy(F.pmod(F.xxhash64("ra", "rb"), F.lit(shards)).alias("table")).applyInArrow(_accumulate, _DONE)
    done = written(low)
    if n_top:
        heads = done.filter("parent is null")  # roots of subtrees
        sums = _sums_by_parent(heads)
        upper = written(_top_sums(written(_added(top.drop("bound"), sums)), shard_turns))
        names = send(top.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("over")))
        every = done.unionByName(upper).join(names, ["pa", "pb"], "left")
        parent = F.when(F.col("depth") > 0, F.coalesce("parent", "over"))
        done = every.withColumn("parent", parent).drop("over")
    ends = _ends(occurrences)
    return done.join(ends, ["a", "b"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", *_SUMS,
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
