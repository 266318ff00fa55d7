"""Language-model scoring from a log-frequency Bloom filter.

Training counts every word (and one end a text) and every pair of neighbours in all training texts: numpy
counts of each task, one shuffle by key. A count c is quantised to level 1 + floor(log_BASE c), and the filter
holds (key, 1) ... (key, level); a lookup probes level after level until the first miss, so errors can only
raise a count, and rarely by more than a level. A pair's count is also bounded by its first word's.

The filter is built in blocks of keys, one block for each task, and broadcast in segments of at most
``SEGMENT_BYTES``; a corpus of any size takes several segments. With one segment a text is scored in one pass;
with more, each pass returns the levels it knows, and these are joined by text before scoring.

    P(w | v) = (min(c(v w), c(v)) + PRIOR * P(w)) / (c(v) + PRIOR),    P(w) = (c(w) + 1) / (N + V + 1)

with quantised counts; v of a text's first word is the end mark. The base score uses exact counts: those of
the ``HEAD_WORDS`` most frequent words are broadcast, those of all others are joined by key. (Such a rare word
has few occurrences, so the join has no hot key.)

Words are told apart by 63-bit keys; two of n words share one with probability below n^2 / 2^64.

Results for odd input: null and empty texts are one end token; without training texts N = V = 0 and every
token has probability 1; texts repeated under one id are scored once and give a row each; other columns are not
read; an empty table stays empty; a text of any length is scored whole.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, written
from .tokens import chain, mix, slices, words_of

BASE = 1.5               # a level's counts reach from BASE^(level-1) to BASE^level
PRIOR = 500.0            # weight of the word's own probability against its history's counts
BITS, PROBES = 10, 6     # filter bits for each (key, level), and probes for each lookup
SEGMENT_BYTES = 112 << 20
HEAD_WORDS = 2_000_000
CHUNK, COUNTED_KEYS = 1_000_000, 2_500_000  # bytes of text, and counted keys, that a worker holds at a time
PART_BYTES = 24 << 20    # training text for each task that builds blocks; it builds about four

_END = np.uint64(0x5851F42D4C957F2E)  # key of the end of a text; keys of words are even, those of pairs odd
_ONE, _HALF = np.uint64(1), np.uint64(32)
_BLOCKS = ("block int, n_words long, n_tokens long, histogram array<long>, words binary, counts binary, "
           "n_bits long, bits binary")


def _levels_of(counts: np.ndarray) -> np.ndarray:
    bounds = np.array([math.ceil(BASE ** j - 1e-9) for j in range(110)], dtype=np.float64)
    return np.searchsorted(bounds, counts, side="right").astype(np.int64)


def _level_counts() -> np.ndarray:
    """The count that stands for each level: the middle of the whole numbers it covers."""
    low = np.ceil(BASE ** np.arange(110) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.arange(1, 111) - 1e-9) - 1)
    return np.concatenate([[0.0], (low + high) / 2])


def token_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of tokens (words, then one end a text), keys of pairs, and where each text's tokens begin."""
    words = words_of(texts)
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    tokens = np.empty(int(first[-1]), np.uint64)
    ends = np.zeros(len(tokens), bool)
    ends[first[1:] - 1] = True
    tokens[ends] = _END
    tokens[~ends] = words.key & ~_ONE
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _END
    return tokens, chain(before, tokens) | _ONE, first


def _count_keys(batches: Iterator[pa.RecordBatch], n_blocks: int) -> Iterator[pa.RecordBatch]:
    def emit(parts):
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)
        for a in range(0, len(keys), 500_000):
            part = keys[a:a + 500_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(_block_of(part, n_blocks), pa.int32()), pa.array(part.view(np.int64)),
                pa.array(n[a:a + 500_000])], ["block", "key", "n"])
    held, size = [], 0
    for batch in batches:
        for a, b in slices(batch.column(0), CHUNK):
            tokens, pairs, _ = token_keys(batch.column(0).slice(a, b - a))
            held.append(np.unique(np.concatenate([tokens, pairs]), return_counts=True))
            size += len(held[-1][0])
            if size > COUNTED_KEYS:
                yield from emit(held)
                held, size = [], 0
    if held:
        yield from emit(held)


def _block_of(keys: np.ndarray, n_blocks: int) -> np.ndarray:
    """By the leading bits, so that sorted keys go through the blocks one after the other."""
    return (((keys >> _HALF) * np.uint64(n_blocks)) >> _HALF).astype(np.int32)


def _two_hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    one = chain(keys, np.uint64(level))
    return one, mix(one + np.uint64(0x632BE59BD9B4E019)) | _ONE


def _bit_place(one: np.ndarray, two: np.ndarray, n_bits: np.ndarray | np.uint64, k: int) -> np.ndarray:
    return (((one + two * np.uint64(k)) >> _HALF) * n_bits) >> _HALF


def _build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of keys: exact word counts, and the bits of its part of the filter."""
    held: dict[int, list] = {}
    for batch in batches:
        block, key, n = (batch.column(i).to_numpy() for i in range(3))
        for b in np.unique(block):
            held.setdefault(int(b), []).append((key[block == b].view(np.uint64), n[block == b]))
    for b in sorted(held):
        parts = held.pop(b)
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)
        levels = _levels_of(counts)
        n_bits = int(max(64, BITS * levels.sum()) + 63) // 64 * 64
        bits = np.zeros(n_bits, bool)
        for j in range(1, int(levels.max()) + 1):
            one, two = _two_hashes(keys[levels >= j], j)
            for k in range(PROBES):
                bits[_bit_place(one, two, np.uint64(n_bits), k)] = True
        word = (keys & _ONE) == 0
        tall = np.array([(counts[word] >= 2 ** j).sum() for j in range(40)])
        yield pa.RecordBatch.from_pylist([{
            "block": b, "n_words": int(word.sum()), "n_tokens": int(counts[word].sum()), "histogram": tall.tolist(),
            "words": keys[word].tobytes(), "counts": counts[word].tobytes(), "n_bits": n_bits,
            "bits": np.packbits(bits, bitorder="little").tobytes()}],
            schema=pa.schema([("block", pa.int32()), ("n_words", pa.int64()), ("n_tokens", pa.int64()),
                              ("histogram", pa.list_(pa.int64())), ("words", pa.binary()), ("counts", pa.binary()),
                              ("n_bits", pa.int64()), ("bits", pa.binary())]))


@dataclass
class Segment:
    """Blocks first .. first + len(n_bits) of the filter."""

    first: int
    n_bits: np.ndarray
    start: np.ndarray  # byte at which each block begins
    data: np.ndarray

    def levels(self, keys: np.ndarray, n_blocks: int) -> np.ndarray:
        """Level of each key; 0 for keys that are not in the filter or not of this segment."""
        block = _block_of(keys, n_blocks) - self.first
        at = np.flatnonzero((block >= 0) & (block < len(self.n_bits)))
        out = np.zeros(len(keys), np.uint8)
        key, n_bits, start, level = keys[at], self.n_bits[block[at]], self.start[block[at]], 1
        while len(at):
            one, two = _two_hashes(key, level)
            held = np.arange(len(at))
            for k in range(PROBES):
                place = _bit_place(one[held], two[held], n_bits[held], k)
                byte = self.data[start[held] + (place >> np.uint64(3)).astype(np.int64)]
                held = held[(byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            at, key, n_bits, start = at[held], key[held], n_bits[held], start[held]
            out[at] = level
            level += 1
        return out


@dataclass
class Model:
    n_blocks: int
    n_tokens: int
    n_words: int
    segments: list          # broadcasts of Segment
    head_from: int          # words counted so often are in the head
    head: object            # broadcast of (sorted word keys, exact counts)
    blocks: DataFrame | None
    prior: float = PRIOR

    @property
    def scale(self) -> tuple[int, int, float]:
        return self.n_tokens, self.n_words, self.prior


def train(docs: DataFrame, text: str = "text", segment_bytes: int = SEGMENT_BYTES,
          head_words: int = HEAD_WORDS, part_bytes: int = PART_BYTES, prior: float = PRIOR) -> Model:
    """Count all texts of ``docs`` and build the filter."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_parts = max(8, math.ceil(size / part_bytes))
    n_blocks = 4 * n_parts
    counted = texts.mapInArrow(lambda it: _count_keys(it, n_blocks), "block int, key long, n long")
    blocks = written(counted.repartition(n_parts, "block").mapInArrow(_build_blocks, _BLOCKS))
    total = blocks.agg(F.sum("n_words").alias("v"), F.sum("n_tokens").alias("n")).first()
    taller = blocks.select(F.posexplode("histogram").alias("j", "c")).groupBy("j").agg(F.sum("c").alias("c"))
    taller = {r["j"]: r["c"] for r in taller.collect()}
    head_from = 2 ** min((j for j, c in taller.items() if c <= head_words), default=0)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _word_counts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([key[n >= head_from].tobytes()], pa.binary()),
                                              pa.array([n[n >= head_from].tobytes()], pa.binary())], ["key", "n"])
    rows = blocks.select("words", "counts").mapInArrow(head, "key binary, n binary").collect()
    keys = np.frombuffer(b"".join(bytes(r["key"]) for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(bytes(r["n"]) for r in rows), np.int64)
    order = np.argsort(keys)
    broadcast = spark.sparkContext.broadcast
    return Model(n_blocks, int(total["n"] or 0), int(total["v"] or 0), _segments(spark, blocks, segment_bytes),
                 head_from, broadcast((keys[order], counts[order])), blocks, prior)


def _segments(spark: SparkSession, blocks: DataFrame, limit: int) -> list:
    """Broadcast the filter in runs of blocks of at most ``limit`` bytes (or one block)."""
    sizes = [(r["block"], r["n_bits"]) for r in blocks.select("block", "n_bits").orderBy("block").collect()]
    runs, held = [], 0
    for b, bits in sizes:
        if not runs or held + bits // 8 > limit:
            runs.append([])
            held = 0
        runs[-1].append((b, bits))
        held += bits // 8
    out = []
    for run in runs:
        first = run[0][0]
        n_bits = np.ones(run[-1][0] - first + 1, np.uint64)  # blocks without keys: one bit that is 0
        for b, bits in run:
            n_bits[b - first] = bits
        size = ((n_bits + np.uint64(7)) // np.uint64(8)).astype(np.int64)
        start = np.cumsum(size) - size
        data = np.zeros(int(size.sum()), np.uint8)
        for r in blocks.filter(F.col("block").between(first, run[-1][0])).select("block", "bits").toLocalIterator():
            at = start[r["block"] - first]
            data[at:at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        out.append(spark.sparkContext.broadcast(Segment(first, n_bits, start, data)))
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for key, n in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)


def _text_scores(words: np.ndarray, pairs: np.ndarray, first: np.ndarray, ends: np.ndarray, model) -> np.ndarray:
    """log10 probability of each text from the levels of its tokens and pairs."""
    n_tokens, n_words, prior = model
    counts = _level_counts()
    if not n_tokens:
        return np.zeros(len(first) - 1)
    own, both = counts[words], counts[pairs]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first[:-1]] = counts[ends]
    unigram = (own + 1) / (n_tokens + n_words + 1)
    p = np.minimum(1.0, (np.minimum(both, before) + prior * unigram) / (before + prior))
    return np.add.reduceat(np.log10(p), first[:-1]) if len(first) > 1 else np.zeros(0)


_PART = "n_tokens long, n_head long, head double, rest array<struct<key: long, n: long>>, score double"


def _scorer(model: Model, segment: Segment | None):
    """For each text: n_tokens; n_head and head, the exact base score with every word outside the head taken as
    an unknown one; rest, those words where words exist outside the head; score (nan without a segment)."""
    keys, counts = model.head.value
    low, share, scale, n_blocks = model.head_from, model.n_tokens + model.n_words + 1, model.scale, model.n_blocks
    look = _levels(segment, n_blocks)
    ends = look(np.array([_END]))[0]

    def score(texts: pa.Array) -> list[pa.Array]:
        tokens, pairs, first = token_keys(texts)
        distinct, place = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        known = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
        count = np.where(known, counts[at], 0) if len(keys) else np.zeros(len(distinct), np.int64)
        logs, known, starts = np.log10((count + 1) / share)[place], known[place], first[:-1]
        other = np.flatnonzero(~known) if low > 1 else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))[other]
        rest, n = np.unique(owner * len(distinct) + place[other], return_counts=True)
        rest_keys = distinct[rest % len(distinct)].view(np.int64) if len(rest) else np.zeros(0, np.int64)
        cuts = np.searchsorted(rest, np.arange(len(texts) + 1) * len(distinct))
        total = np.full(len(texts), np.nan) if segment is None and scale[0] else _text_scores(
            segment.levels(distinct, n_blocks)[place] if segment else np.zeros(len(tokens), np.uint8),
            look(pairs), first, ends, scale)
        items = pa.StructArray.from_arrays([pa.array(rest_keys), pa.array(n.astype(np.int64))], ["key", "n"])
        return [pa.array(np.diff(first)), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                pa.array(np.add.reduceat(logs, starts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items),
                pa.array(total)]
    return score


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, n_tokens, n_known, base_score and score (log10)."""
    require(docs, id_col, text)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    sent = dataclasses.replace(model, blocks=None)  # what the workers get
    single = len(model.segments) <= 1

    @F.arrow_udf(_PART)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = _scorer(sent, sent.segments[0].value if single and sent.segments else None)
        for texts in batches:
            parts = [of(texts.slice(a, b - a)) for a, b in slices(texts, CHUNK)]
            columns = [pa.concat_arrays(c) for c in zip(*parts)]
            yield pa.StructArray.from_arrays(columns, ["n_tokens", "n_head", "head", "rest", "score"])

    scored = rows.select("id", "mark", score("text").alias("s")).select("id", "mark", "s.*")
    if model.head_from > 1 or not single:
        scored = written(scored)
    known = F.col("n_head").alias("n_known")
    if model.head_from == 1:
        scored = scored.select("id", "mark", "n_tokens", known, F.col("head").alias("base_score"), "score")
    else:
        tail = _tail_part(scored, model)
        scored = scored.join(tail.withColumnsRenamed({"id": "tail_id", "mark": "tail_mark"}),
                             F.col("id").eqNullSafe(F.col("tail_id")) & (F.col("mark") == F.col("tail_mark")), "left")
        scored = scored.select("id", "mark", "n_tokens", (F.col("n_head") + F.coalesce("n", F.lit(0))).alias("n_known"),
                               (F.col("head") + F.coalesce("add", F.lit(0.0))).alias("base_score"), "score")
    if not single:
        scored = _joined_score(rows, scored, model)
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", "base_score", "score")


def _levels(segment: Segment | None, n_blocks: int):
    def look(keys: np.ndarray) -> np.ndarray:
        if segment is None:
            return np.zeros(len(keys), np.uint8)
        distinct, place = np.unique(keys, return_inverse=True)
        return segment.levels(distinct, n_blocks)[place]
    return look


def _tail_part(scored: DataFrame, model: Model) -> DataFrame:
    """id, mark, n (tokens), add: what the counts of words outside the head add to the base score."""
    low = model.head_from

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _word_counts(batches):
            key, n = key[n < low], n[n < low]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "c"])
    counts = model.blocks.select("words", "counts").mapInArrow(tail, "key long, c long")
    asked = scored.select("id", "mark", F.explode("rest").alias("w")).select("id", "mark", "w.key", "w.n").distinct()
    found = asked.join(counts, "key").groupBy("id", "mark")
    return found.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("add"))


def _joined_score(rows: DataFrame, scored: DataFrame, model: Model) -> DataFrame:
    """Scores from several segments: levels of each pass, joined by text (a text is bounded, so is its group)."""
    n_blocks, scale = model.n_blocks, model.scale

    def levels_of(segment) -> Column:
        @F.arrow_udf("words binary, pairs binary, ends int")
        def levels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            look = _levels(segment.value, n_blocks)
            ends = int(look(np.array([_END]))[0])
            for texts in batches:
                own, both = [], []
                for a, b in slices(texts, CHUNK):
                    tokens, pairs, first = token_keys(texts.slice(a, b - a))
                    words, twos = look(tokens), look(pairs)
                    own += [words[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
                    both += [twos[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
                yield pa.StructArray.from_arrays(
                    [pa.array(own, pa.binary()), pa.array(both, pa.binary()),
                     pa.array([ends] * len(own), pa.int32())], ["words", "pairs", "ends"])
        return levels("text")

    passes = [written(rows.select("id", "mark", levels_of(s).alias("l")).select("id", "mark", "l.*"))
              for s in model.segments]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)

    @F.pandas_udf("double")
    def total(words: pd.Series, pairs: pd.Series, ends: pd.Series) -> pd.Series:
        best = lambda parts: np.max([np.frombuffer(p, np.uint8) for p in parts], axis=0)
        return pd.Series([_text_scores(w := best(a), best(b), np.array([0, len(w)]), int(max(e)), scale)[0]
                          for a, b, e in zip(words, pairs, ends)])
    lists = every.groupBy("id", "mark").agg(*[F.collect_set(c).alias(c) for c in ("words", "pairs", "ends")])
    by_text = lists.select(F.col("id").alias("by_id"), F.col("mark").alias("by_mark"),
                           total("words", "pairs", "ends").alias("joined"))
    out = scored.join(by_text, F.col("id").eqNullSafe(F.col("by_id")) & (F.col("mark") == F.col("by_mark")))
    return out.select("id", "n_tokens", "n_known", "base_score", F.col("joined").alias("score"))
