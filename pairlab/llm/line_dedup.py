"""Fuzzy line dedup by MinHash, in DataFrame functions only.

1. A line is its text's 64-bit hash; equal lines are one node. (Two of n different lines share a hash with
   probability below n^2 / 2^64.) Blank lines are left alone.
2. Signatures: the shingles of a line are its windows of ``SHINGLE`` characters (UTF-16 units, so one beyond the BMP
   counts as two; a shorter line is one window).
   They are exploded and hashed in generated code, and one aggregation keeps the least value of each of
   ``BANDS * ROWS`` permutations: four multiples of the 32-bit hash, each xor with six starts. Shingles that are not
   near any start (``EXPECTED`` of a line are expected to be near each) are left out of the aggregation first; a line where a
   least value is farther off is done again with all its shingles. So the values are those of all shingles, however long
   the line is, and lines with the same shingles have the same signature.
3. Banding: lines with the same ``ROWS`` least values in a band share a bucket. Of the pairs to compare, those
   that agree in fewer than ``AGREE`` of all least values are let go (similar ones agree in four of five), and so are
   those whose bitmaps show that they cannot be similar: each line of a bucket has one of ``64 * WORDS`` bits, a hash of
   each shingle sets one, and a bit that only one of two lines has stands for a shingle at least that the other lacks.
   Both are conditions of the bucket's join, so that pairs let go never become rows.
4. Verification: the exact Jaccard similarity of all shingles, ``PERCENT`` / 100 or more. In each bucket every
   line is compared with the one that has most copies, then with more and more of the bucket's lines, until all are. Two lines that
   are in one component by then (by this or any other bucket) are not compared, and a bucket whose lines all are is
   done. So a bucket of near copies of one line costs about as many comparisons as it has lines; one whose lines
   stay apart costs up to all its pairs.
5. Components of the links by distributed union-find; of each component the first line, in order of
   (doc_id, hash of the text, line number), stays.

Signatures find a pair of similarity 0.8 with a probability of about 0.99, and more similar ones more surely.

Results for odd input: null text is no text (it stays null); an empty text or one of blank lines is unchanged; a
document whose lines all go stays with an empty text; rows given twice are treated alike (both keep the lines
that the first keeps); a null doc_id comes first; other columns pass through; an empty table stays empty;
lines of any length are read whole.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, passing, require, written
from .components import connected_components

SHINGLE, PERCENT = 8, 80
BANDS, ROWS, AGREE = 8, 3, 12
WORDS = 32                # words of 64 bits of a line's bitmap
SEND_BYTES = 32 << 20     # tables up to this size are broadcast, larger ones are joined by a shuffle
TASK_PAIRS = 1_000        # pairs whose shingles one task counts
MORE_COMPARED = 32        # growth, from round to round, of the lines of a bucket that the others are compared with
_WORDS = [f"w{k}" for k in range(WORDS)]
EXPECTED = 7              # shingles of a line that are expected to be near each of the starts
_rng = random.Random(5)
_TURNS = [_rng.getrandbits(31) | 1 for _ in range(4)]  # h -> a h mod 2^32
_FULL, _NEAR = (1 << 32) - 1, (1 << 29) - 1
_MINS = [f"m{k}" for k in range(BANDS * ROWS)]
_PLACES = [(m, k % 4, (k // 4) << 29) for k, m in enumerate(_MINS)]  # permutation: h_j xor a start


def _sent(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() * row_bytes <= SEND_BYTES else table


def _lines(docs: DataFrame) -> DataFrame:
    """id, mark, pos, line, lh for each line that is not blank. ``docs``: id, mark, text."""
    lines = docs.select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.filter(F.trim("line", F.lit(" \t\r\f\v")) != "").withColumn("lh", F.xxhash64("line"))


def _windows(lines: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns, the number and the window of each shingle, cut in one step each from ``wide``, the line in UTF-16;
    ``n``: the number of windows."""
    at = lines.select(*kept, "wide", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return at.select(*kept, "i", F.substring("wide", 2 * F.col("i") + 1, F.lit(2 * SHINGLE)).alias("window"))


def _widened(line: Column) -> tuple[Column, Column]:
    """``wide`` and ``n`` for ``_windows``."""
    wide = F.encode(line, "UTF-16LE")
    return wide.alias("wide"), F.greatest((F.octet_length(wide) / 2).cast("int") - SHINGLE + 1, F.lit(1)).alias("n")


def _least(hashed: DataFrame, *by: str) -> DataFrame:
    """The least values of each group. ``hashed``: by and h, the hash of a shingle."""
    turned = hashed.select(*by, *[(F.col("h") * F.lit(a)).bitwiseAND(F.lit(_FULL)).alias(f"h{j}") for j, a in enumerate(_TURNS)])
    least = turned.groupBy(*by).agg(*[F.min(F.col(f"h{j}").bitwiseXOR(F.lit(c))).alias(m) for m, j, c in _PLACES])
    return least.select(*by, *[(F.col(m) - F.lit(1 << 31)).cast("int").alias(m) for m in _MINS])


def signatures(lines: DataFrame) -> DataFrame:
    """lh and the least values m0, m1, ... of each line. ``lines``: lh, line."""
    cap = F.least(F.lit(_NEAR), F.floor(F.lit(float(EXPECTED << 32)) / F.col("n"))).cast("long")
    wide = lines.select("lh", *_widened(F.col("line"))).withColumn("cap", cap)
    number = F.hash("window").cast("long").bitwiseAND(F.lit(_FULL))
    few = [(F.col("h") * F.lit(a)).bitwiseAND(F.lit(_NEAR)) <= F.col("cap") for a in _TURNS]
    few = reduce(Column.__or__, few, F.col("i") == 0)  # the first one too, so that each line has a row
    some = _least(_windows(wide, "lh", "cap").select("lh", "cap", "i", number.alias("h")).filter(few), "lh", "cap")
    some = written(some.select("lh", F.col("cap").cast("int").alias("cap"), *_MINS))
    # least values up to the cap are those of all shingles
    whole = (F.col("cap") == _NEAR) | (F.greatest(*_MINS).cast("long") + F.lit(1 << 31) <= F.col("cap"))
    left = written(some.filter(~whole).select("lh"))
    again = wide.filter(F.col("cap") < _NEAR).join(_sent(left, 40), "lh", "left_semi")
    again = written(_least(_windows(again, "lh").select("lh", number.alias("h")), "lh"))
    return some.filter(whole).select("lh", *_MINS).unionByName(again)


def _buckets(signed: DataFrame) -> DataFrame:
    """bucket, lh of the buckets with two lines or more."""
    bands = F.array(*[F.xxhash64(F.lit(b), *_MINS[b * ROWS:(b + 1) * ROWS]) for b in range(BANDS)])
    rows = signed.select(F.explode(bands).alias("bucket"), "lh")
    shared = written(rows.groupBy("bucket").agg(F.min("lh").alias("a"), F.max("lh").alias("b")).filter("a < b")
                     .select("bucket"))
    return rows.join(_sent(shared, 40), "bucket").distinct()


def likely(pairs: DataFrame, mins: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in enough least values. ``mins``: lh and the least values."""
    side = lambda x: mins.select(F.col("lh").alias(x), F.struct(*_MINS).alias(f"mins_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = sum((F.col("mins_a")[m] == F.col("mins_b")[m]).cast("int") for m in _MINS)
    return both.filter(same >= AGREE).select("a", "b")


def bitmaps(texts: DataFrame) -> DataFrame:
    """lh, n (windows of the line) and the words w0, w1, ... of its bitmap. ``texts``: lh, line."""
    wide = texts.select("lh", *_widened(F.col("line")))
    bits = _windows(wide, "lh", "n").select("lh", "n", F.xxhash64("window").alias("h"))
    bits = bits.groupBy("lh", "n", F.pmod(F.shiftright("h", 6), F.lit(WORDS)).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    return bits.groupBy("lh", "n").agg(*[
        F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(WORDS)])


def _may_be(end: str) -> Column:
    """Whether the bitmaps of two lines, the other's columns ending in ``end``, leave open that they are similar."""
    both = sum(F.bit_count(F.col(w).bitwiseAND(F.col(w + end))) for w in _WORDS)  # named once: a condition is read as it stands
    least = lambda n, own, other: PERCENT * (F.col(n) + F.col(other)) - 100 * (F.col(n) - F.col(own))
    return (100 + PERCENT) * both >= F.greatest(least("n", "bits", "bits" + end), least("n" + end, "bits" + end, "bits"))


def _counted(maps: DataFrame) -> DataFrame:
    """``maps`` and the number of each one's bits, written: the planner would go through all renamings of such a sum."""
    return written(maps.withColumn("bits", sum(F.bit_count(w) for w in _WORDS)))


def possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave open that they are similar: with x shingles that only a has and y that only b
    has, their similarity is (m - x) / (m + y) for the m shingles of a, and no smaller with more than m."""
    known = _counted(maps)
    sent = F.broadcast if known.count() * (16 + 8 * WORDS) <= SEND_BYTES else lambda x: x
    two = known.select(F.col("lh").alias("b"), *[F.col(c).alias(c + "_b") for c in known.columns if c != "lh"])
    return pairs.join(sent(known.withColumnRenamed("lh", "a")), "a").join(sent(two), "b").filter(_may_be("_b")).select("a", "b")


def _meetings(opened: DataFrame, heads: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of a line and a head of its bucket, not of one component, that may be similar. Least values and bitmaps
    are compared where the bucket is, so that only pairs that pass become rows."""
    left = opened.select("bucket", "lh", "label").join(known, "lh")
    other = [c for c in known.columns if c != "lh"]
    right = heads.join(known.select(F.col("lh").alias("head"), *[F.col(c).alias(c + "_h") for c in other]), "head")
    same = sum((F.col(m) == F.col(m + "_h")).cast("int") for m in _MINS)
    met = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("of_head") != F.col("label"))
                    & (same >= AGREE) & _may_be("_h"))
    return met.select(F.least("head", "lh").alias("a"), F.greatest("head", "lh").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are similar, by the exact similarity of their shingles. ``texts``: lh, line.
    A task gets a bounded number of pairs, so that their shingles stay in its memory."""
    tasks = max(1, -(-pairs.count() // TASK_PAIRS))
    both = pairs.join(texts.select(F.col("lh").alias("a"), F.col("line").alias("of_a")), "a")
    both = both.join(texts.select(F.col("lh").alias("b"), F.col("line").alias("of_b")), "b")
    sides = both.select("a", "b", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col("of_a").alias("line")),
        F.struct(F.lit(2).alias("side"), F.col("of_b").alias("line")))).alias("s"))
    # the shingles of both sides are counted where the pair is, without another shuffle
    wide = sides.repartition(tasks, "a", "b").select("a", "b", "s.side", *_widened(F.col("s.line")))
    items = _windows(wide, "a", "b", "side")
    held = items.groupBy("a", "b", F.xxhash64("window").alias("item")).agg(F.bit_or("side").alias("sides"))
    count = held.groupBy("a", "b").agg(F.count_if(F.col("sides") == 3).alias("shared"),
                                                F.count(F.lit(1)).alias("every"))
    return count.filter(F.col("shared") * 100 >= F.col("every") * PERCENT).select("a", "b")


def _linked(buckets: DataFrame, texts: DataFrame, mins: DataFrame, copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all similar lines that share a bucket, and their components (node, label). ``copies``: lh, n (equal
    lines); the line of a bucket with most is the first that the others are compared with, as near copies are near to it
    rather than to one another."""
    sized = buckets.join(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    often = F.lit(1).cast("long")
    if copies is not None:
        sized, often = sized.join(_sent(copies.select("lh", F.col("n").alias("often")), 40), "lh"), F.col("often")
    sized = written(sized.select("bucket", "lh", "n", often.alias("often")))
    most = sized.groupBy("bucket").agg(F.max("often").alias("often"))
    heads = written(sized.join(most, ["bucket", "often"]).groupBy("bucket").agg(F.min("lh").alias("head")))
    met = sized.join(heads, "bucket").filter("head <> lh")
    pairs = written(met.select(F.least("head", "lh").alias("a"), F.greatest("head", "lh").alias("b")).distinct())
    links = written(verified(written(likely(pairs, mins)), texts))
    labels = written(connected_components(links))
    opened, seen, compared = sized, pairs, 1
    while True:
        # a bucket is done when its lines are of one component, or all of them have been heads
        named = opened.select("bucket", "lh", "n").join(labels.withColumnRenamed("node", "lh"), "lh", "left")
        named = named.withColumn("label", F.coalesce("label", "lh"))
        several = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("n").alias("n"))
        several = several.filter((F.col("x") < F.col("y")) & (F.col("n") > max(compared, 2)))
        opened = written(named.join(several.select("bucket"), "bucket").select("bucket", "lh", "n", "label"))
        if opened.isEmpty():
            return links, labels
        if compared == 1:
            there = written(opened.select("lh").distinct())
            maps = bitmaps(texts.join(_sent(there, 40), "lh", "left_semi"))
            known = written(mins.join(_counted(maps), "lh"))
        compared *= MORE_COMPARED
        chosen = F.pmod(F.xxhash64("lh"), F.col("n")) < compared  # about as many of each bucket, all of one that has no more
        heads = opened.filter(chosen).select("bucket", F.col("lh").alias("head"), F.col("label").alias("of_head"))
        pairs = written(_meetings(opened, written(heads), known).join(seen, ["a", "b"], "left_anti"))
        seen = seen.unionByName(pairs)
        found = written(verified(pairs, texts))
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = written(connected_components(links))


def _links(buckets: DataFrame, texts: DataFrame, mins: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    return _linked(buckets, texts, mins, copies)[0]


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark (hash of the text), removed: line numbers (from 0) that go, for texts that lose any."""
    keyed = _keyed(docs, id_col, text)
    lines = _lines(keyed)
    placed = written(lines.select("lh", "id", "mark", "pos"))
    nodes = written(placed.groupBy("lh").agg(F.count(F.lit(1)).alias("n"),
                                             F.min(F.struct("id", "mark", "pos")).alias("first")))
    signed = signatures(lines.select("lh", "line"))
    buckets = written(_buckets(signed))
    wanted = written(buckets.select("lh").distinct())
    asked = nodes.join(_sent(wanted, 40), "lh").select(
        "lh", F.col("first.id").alias("at_id"), F.col("first.mark").alias("at_mark"), F.col("first.pos").alias("at_pos"))
    here = F.col("id").eqNullSafe(F.col("at_id")) & (F.col("mark") == F.col("at_mark")) & (F.col("pos") == F.col("at_pos"))
    texts = written(lines.join(_sent(written(asked), 120), "lh").filter(here).select("lh", "line").dropDuplicates(["lh"]))
    mins = written(signed.join(_sent(wanted, 40), "lh"))
    labels = _linked(buckets, texts, mins, nodes)[1].withColumnRenamed("node", "lh")
    named = nodes.join(labels, "lh", "left").withColumn("label", F.coalesce("label", "lh"))
    classes = named.groupBy("label").agg(F.sum("n").alias("lines"), F.min("first").alias("kept"))
    repeated = named.join(classes.filter("lines > 1"), "label").select("lh", "kept")
    here = F.struct("id", "mark", "pos").eqNullSafe(F.col("kept"))
    gone = placed.join(_sent(written(repeated), 120), "lh").filter(~here)
    return gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the remaining lines of each text."""
    require(docs, id_col, text)
    with passing(docs.sparkSession):  # the tables of the search go with it
        removed = keep(removed_lines(docs, id_col, text))
    by_id, by_mark, gone = fresh(docs, "by_id", "by_mark", "gone_lines")
    removed = removed.select(F.col("id").alias(by_id), F.col("mark").alias(by_mark), F.col("removed").alias(gone))
    size = removed.agg(F.sum(F.size(gone))).first()[0] or 0
    removed = _sent(removed, 100) if size * 8 <= SEND_BYTES else removed
    joined = docs.join(removed, docs[id_col].eqNullSafe(F.col(by_id)) & (F.xxhash64(docs[text]) == F.col(by_mark)), "left")
    staying = lambda lines: F.transform(  # noqa: E731  linear in the lines, however many go
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: lines[i])
    left = F.transform(F.array(F.split(F.col(text), "\n", -1)), staying)[0]  # split once
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return joined.withColumn(text, kept).select(*docs.columns)
