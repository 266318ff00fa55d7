"""Benchmark decontamination as a prefix-filtered join of word windows.

An item of the benchmark is cut into windows of ``width`` consecutive words (a shorter item is one window). A
window's tokens are its word shingles; containment of the whole window makes a prefix of one token necessary,
and the token chosen is the rarest in the documents, by counts over all of them. A document position joins a
window only where the document has that token; then the bounds are applied (enough words of this document
before and after the token), the word keys are compared over the window's length, and last the words themselves.

Documents are never shuffled. The benchmark's windows are broadcast in blocks of at most ``block_words`` words,
whose size is thus bounded; a benchmark of any size takes several blocks, and their hits are joined in the row.

Results for odd input: null and empty texts have no words and no hits; null item texts and null item ids are
left out; items with one text each count; repeated document rows each get a row; an empty benchmark hits
nothing; an empty document table stays empty; other columns pass through under names that do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import ALPHANUMERIC, Words, chain, slices, words_of

#: Words of a window, words of a token, and words that one broadcast block of the benchmark holds at most.
WIDTH = 10
SHINGLE = 3
BLOCK_WORDS = 200_000

_HITS = "n_words long, hits array<struct<start: int, end: int, item: string>>"


def shingle_keys(words: Words, size: int) -> np.ndarray:
    """Key of the ``size`` words that begin at each word; those reaching past a text's end are never asked for."""
    key = words.key
    out = key.copy()
    for k in range(1, size):
        out[:len(out) - k] = chain(out[:len(out) - k], key[k:]) if len(key) > k else out[:0]
    return out


@dataclass
class Windows:
    """Distinct windows of a block, sorted by the key of their prefix token."""

    token: np.ndarray         # key of the prefix token
    size: np.ndarray          # words of the prefix token
    shift: np.ndarray         # its place in the window
    length: np.ndarray
    keys: np.ndarray          # word keys, 0 beyond the length
    text: list[bytes]
    items: list[list[str]]

    def __post_init__(self):
        self.tokens = {int(s): np.unique(self.token[self.size == s]) for s in np.unique(self.size)}


def _cut(items: list[tuple[str, str]], width: int, shingle: int):
    """Distinct windows as {text: (word keys, token sizes, token keys, items)}."""
    out: dict[bytes, tuple] = {}
    words = words_of(pa.array([t for _, t in items], pa.large_string()), ALPHANUMERIC)
    by_size = {s: shingle_keys(words, s) for s in range(1, shingle + 1)}
    for i, (item, _) in enumerate(items):
        a, b = int(words.first[i]), int(words.first[i + 1])
        for start in range(a, max(a + 1, b - width + 1)) if b > a else ():
            stop = min(b, start + width)
            size = min(shingle, stop - start)
            tokens = by_size[size][start:stop - size + 1]
            out.setdefault(words.text(start, stop), (words.key[start:stop], size, tokens, []))[3].append(item)
    return out


def _document_frequencies(docs: DataFrame, text: str, tokens: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """In how many documents each token of the benchmark occurs; the result has the benchmark's size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {s: np.zeros(len(t), np.int64) for s, t in tokens.items()}
        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column):
                words = words_of(column.slice(a, b - a), ALPHANUMERIC)
                owner = np.repeat(np.arange(b - a), np.diff(words.first))
                for s, keys in tokens.items():
                    own = shingle_keys(words, s)
                    at, place = _probe(own, keys)
                    inside = at + s <= words.first[owner[at] + 1]
                    pairs = np.unique(owner[at[inside]] * len(keys) + place[inside])
                    found[s] += np.bincount(pairs % len(keys), minlength=len(keys))
        for s, n in found.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s), pa.int32()), pa.array(k, pa.int64()),
                                              pa.array(n[k], pa.int64())], ["s", "k", "n"])
    rows = docs.select(text).mapInArrow(count, "s int, k long, n long").groupBy("s", "k").agg(F.sum("n").alias("n"))
    out = {s: np.zeros(len(t), np.int64) for s, t in tokens.items()}
    for r in rows.toLocalIterator():
        out[r["s"]][r["k"]] = r["n"]
    return out


def _probe(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``own`` whose key is among the sorted ``keys``, and the place there. A bitmap of key prefixes
    spares most binary searches."""
    bits = max(10, int(len(keys)).bit_length() + 4)
    seen = np.zeros(1 << bits, bool)
    seen[keys >> np.uint64(64 - bits)] = True
    at = np.flatnonzero(seen[own >> np.uint64(64 - bits)])
    place = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
    right = keys[place] == own[at]
    return at[right], place[right]


def _block(items, docs, text, width, shingle) -> Windows | None:
    cut = _cut(items, width, shingle)
    if not cut:
        return None
    sizes = sorted({size for _, size, _, _ in cut.values()})
    tokens = {s: np.unique(np.concatenate([t for _, z, t, _ in cut.values() if z == s])) for s in sizes}
    often = _document_frequencies(docs, text, tokens)
    shift = [int(np.argmin(often[z][np.searchsorted(tokens[z], t)])) for _, z, t, _ in cut.values()]
    token = np.array([t[k] for k, (_, _, t, _) in zip(shift, cut.values())], np.uint64)
    order = np.argsort(token, kind="stable")
    keys = np.zeros((len(cut), width), np.uint64)
    for i, (k, _, _, _) in enumerate(cut.values()):
        keys[i, :len(k)] = k
    rows, texts = list(cut.values()), list(cut)
    return Windows(token[order], np.array([z for _, z, _, _ in rows])[order], np.array(shift)[order],
                   np.array([len(k) for k, _, _, _ in rows])[order], keys[order], [texts[i] for i in order],
                   [sorted(set(rows[i][3])) for i in order])


def _find(words: Words, windows: Windows) -> list[list[tuple[int, int, str]]]:
    """For each text the hits (first word, end, item), adjacent and overlapping ones of an item joined."""
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    found: list[list] = [[] for _ in range(len(words.first) - 1)]
    for size, keys in windows.tokens.items():
        own = shingle_keys(words, size)
        at, place = _probe(own, keys)
        low = np.searchsorted(windows.token, keys[place], "left")
        high = np.searchsorted(windows.token, keys[place], "right")
        many = high - low
        at = np.repeat(at, many)
        w = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = at - windows.shift[w]
        fits = (windows.size[w] == size) & (begin >= words.first[owner[at]])
        fits &= begin + windows.length[w] <= words.first[owner[at] + 1]
        at, w, begin = at[fits], w[fits], begin[fits]
        for k in range(windows.keys.shape[1]):  # word keys, position by position
            same = windows.length[w] <= k
            same |= words.key[np.minimum(begin + k, len(words.key) - 1)] == windows.keys[w, k]
            at, w, begin = at[same], w[same], begin[same]
        for i, j, b in zip(owner[at].tolist(), w.tolist(), begin.tolist()):
            n = int(windows.length[j])
            if words.text(b, b + n) == windows.text[j]:
                b -= int(words.first[i])
                found[i] += [(b, b + n, item) for item in windows.items[j]]
    return [_joined(f) for f in found]


def _joined(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, item in sorted(hits, key=lambda h: (h[2], h[0], h[1])):
        if out and out[-1][2] == item and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), item)
        else:
            out.append((a, b, item))
    return out


def benchmark_blocks(docs: DataFrame, items: DataFrame, text: str = "text", width: int = WIDTH,
                     shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> list:
    """The benchmark's windows as broadcasts of bounded size. ``items``: item_id, text."""
    spark: SparkSession = docs.sparkSession
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("item is not null and text is not null").orderBy("item", "text")
    out, part, n = [], [], 0

    def close() -> None:
        if block := _block(part, docs, text, width, shingle):
            out.append(spark.sparkContext.broadcast(block))
    for r in rows.toLocalIterator():
        part.append((r["item"], r["text"]))
        n += len(r["text"]) // 2 + 1  # no text has more words
        if n >= block_words:
            close()
            part, n = [], 0
    close()
    return out


def contamination(text: Column, blocks: list) -> Column:
    """struct(n_words, n_hit, items, hits): words of the text inside any window of the benchmark."""
    def column(block) -> Column:
        @F.arrow_udf(_HITS)
        def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            windows = block.value if block is not None else None
            for texts in batches:
                n, found = [], []
                for a, b in slices(texts):
                    words = words_of(texts.slice(a, b - a), ALPHANUMERIC)
                    n.append(np.diff(words.first))
                    found += _find(words, windows) if windows else [[]] * (b - a)
                spans = [[{"start": a, "end": b, "item": i} for a, b, i in f] for f in found]
                yield pa.StructArray.from_arrays([pa.array(np.concatenate(n or [[]]), pa.int64()), pa.array(
                    spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())])))],
                    ["n_words", "hits"])
        # not deterministic for the planner, which else moves a filter on its result to where it can't be evaluated
        return hits.asNondeterministic()(text)
    parts = [column(b) for b in blocks or [None]]
    every = F.sort_array(F.concat(*[p["hits"] for p in parts]))
    return F.struct(parts[0]["n_words"].alias("n_words"), every.alias("hits"))


def summary(hits: Column) -> Column:
    """struct(n_hit, items) of hits sorted by their start: words in the union of the spans, distinct items."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(hits, start, lambda acc, h: F.struct(
        F.greatest(acc["end"], h["end"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(acc["end"], h["start"]))).cast("long").alias("n")),
        lambda acc: acc["n"])
    return F.struct(covered.alias("n_hit"),
                    F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item"]))).alias("items"))
