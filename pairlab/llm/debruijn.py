"""Substring dedup on a compacted De Bruijn graph of word windows.

A vertex is a sequence of ``WIDTH`` words that starts in documents with different ids, an edge a sequence of
WIDTH + 1 words whose two windows are vertices. A vertex is named by its source coordinate: the place of its first
occurrence, in order of (id, place); so neighbours in a repeated passage have neighbouring names.

1. Windows. Texts are read in slices of several megabytes; each word of the corpus has a number (its slice's base
   plus its place there). Of windows that a slice holds more than once only the first goes on; the others refer to
   it. So a window that many documents hold is sent once for a slice. Keys are dealt by hash to tasks of about
   ``BUCKET_WINDOWS`` windows, packed with their documents' ids; bucket and key come from different sums, so windows
   are told apart by 64 bits and those of the bucket.
2. Names. A task finds the first occurrence of each key; to each occurrence in a document with a greater id it sends
   back that coordinate. Occurrences with neighbouring names are one stretch.
3. Compaction. Where a stretch ends and another (or a passage that is itself a source) begins at the next word,
   the graph leaves the source's line: an edge between two lines. Joins on words' numbers give these edges, cut lines
   where they leave or enter, and count edges into and out of each end. Ends joined by the only edge of both are one
   path; chains of them are components (Spark joins again). Occurrences of paths are the pieces of stretches.
4. Verification. In a stretch of two windows or more the coordinates agree twice, so 128 bits do. Single windows are
   compared with their source word by word (by sha256, in both documents); if any differs, two windows had one key,
   and everything is done again with other keys.

Results for odd input: a null or empty text has no words; a row without an id is neither a source nor shortened;
rows with one id are never sources for each other, repeated rows get equal results; a text is held whole by a task,
a slice is at least one text; no other column is read, and names may clash with none but id and text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, require, written
from .components import connected_components
from .tokens import chain, mix, slices, words_of

WIDTH = 13
BUCKET_WINDOWS = 1_500_000
SLICE_BYTES = 3_000_000
SENT_IDS = 2_000_000   # up to so many ids of documents to verify are broadcast (50 MB), and only their texts are shuffled
_NEAR = 12             # a block of a line has 2^12 words

_PACKED = "route long, base long, ids binary, marks binary, words binary, at binary, keys binary"
_NAMED = "base long, ids binary, marks binary, words binary, at binary, source_base binary, source binary"
_STRETCH = "id long, mark long, words int, start long, base long, at long, n long, source_base long, source long"


# ---------------------------------------------------------------- packed columns
def _pack(x: np.ndarray) -> bytes:
    """Differences of a column, byte plane by byte plane: near numbers leave planes of zeros, which compress well."""
    x = np.diff(x.astype(np.int64), prepend=0)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(raw) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _buffers(column) -> list:
    return [None if x.as_py() is None else x.as_buffer() for x in column]


# ---------------------------------------------------------------- windows
def window_keys(words: np.ndarray, width: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, bucket key) of each window of ``width`` words, from keys of powers of two."""
    n = max(0, len(words) - width + 1)
    power, have, at = words, 1, 0
    key, other = np.full(n, salt, np.uint64), np.full(n, salt + 1, np.uint64)
    while have <= width:
        if width & have:
            key = chain(key, power[at:at + n])
            other = other * np.uint64(0x9E3779B97F4A7C15) + power[at:at + n]
            at += have
        power = chain(power[:max(0, len(power) - have)], power[have:])
        have *= 2
    return key, mix(other)


def _windows(width: int, buckets: int, salt: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, marks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for a, b in slices(texts, slice_bytes):
                words = words_of(texts.slice(a, b - a), lower=False)
                yield _slice_rows(words.key, words.first, ids[a:b], marks[a:b], base, width, buckets, salt)
                base += len(words.key) + 1  # a base of its own, also without words
    return run


def _slice_rows(words: np.ndarray, first: np.ndarray, ids: np.ndarray, marks: np.ndarray, base: int, width: int,
                buckets: int, salt: int) -> pa.RecordBatch:
    key, other = window_keys(words, width, salt)
    whole = np.zeros(len(words) + 1, np.int64)  # windows inside one text
    some = np.flatnonzero(np.diff(first) >= width)
    whole[first[some]] += 1
    whole[first[some + 1] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    key, other = key[at], other[at]
    owner = ids[np.searchsorted(first, at, "right") - 1]
    order = np.argsort(key, kind="stable")
    lead = np.concatenate([[True], np.diff(key[order]) != 0]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(lead) - 1
    many = np.bincount(group)[group] > 1 if len(order) else lead
    twice, own = order[many], group[many]
    twice = twice[np.lexsort((at[twice], owner[twice], own))]
    start = np.concatenate([[True], np.diff(own) != 0]) if len(own) else np.zeros(0, bool)  # own is in order
    refer = twice[start][np.cumsum(start) - 1]
    rest, refer = twice[~start], refer[~start]
    back = np.argsort(rest)
    sent = np.ones(len(at), bool)
    sent[rest] = False
    info = [_pack(ids), _pack(marks), _pack(np.diff(first))]
    rows = [(-1 - base, base, *info, _pack(at[rest[back]]), _pack(at[refer[back]]))]
    bucket = (other[sent] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    place, key = at[sent][by], key[sent][by]
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        x, y = int(cuts[i]), int(cuts[i + 1])
        rows.append((i, base, info[0], None, info[2], _pack(place[x:y]), key[x:y].tobytes()))
    types = [pa.int64(), pa.int64()] + [pa.binary()] * 5
    names = ["route", "base", "ids", "marks", "words", "at", "keys"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _name(table: pa.Table) -> pa.Table:
    """Coordinates of first occurrences, for the others of a bucket; rows that describe a slice pass."""
    names = ["base", "ids", "marks", "words", "at", "source_base", "source"]
    types = [pa.int64()] + [pa.binary()] * 6
    if table.column("route")[0].as_py() < 0:
        out = table.select(["base", "ids", "marks", "words", "at", "keys"]).to_pydict()
        out["source"], out["source_base"] = out.pop("keys"), [None] * table.num_rows
        return pa.table({n: pa.array(out[n], t) for n, t in zip(names, types)})
    base = table.column("base").to_numpy()
    at = [_unpack(x) for x in _buffers(table.column("at"))]
    owner = [_unpack(i)[np.searchsorted(np.cumsum(_unpack(w)), p, "right")] for i, w, p in
             zip(_buffers(table.column("ids")), _buffers(table.column("words")), at)]
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in _buffers(table.column("keys"))])
    part = np.repeat(np.arange(len(at)), [len(x) for x in at])
    at, owner = np.concatenate(at), np.concatenate(owner)
    order = np.argsort(key, kind="stable")
    there = key[order]
    same = there[1:] == there[:-1]
    rows = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    del order, there, same
    rows = rows[np.lexsort((at[rows], base[part[rows]], owner[rows], key[rows]))]
    lead = np.concatenate([[True], np.diff(key[rows]) != 0]) if len(rows) else np.zeros(0, bool)
    source = rows[lead][np.cumsum(lead) - 1] if len(rows) else rows
    later = owner[rows] > owner[source]
    rows, source = rows[later], source[later]
    back = np.argsort(rows)  # by slice, then place
    rows, source = rows[back], source[back]
    out = []
    cuts = np.searchsorted(part[rows], np.arange(table.num_rows + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        r, s = rows[cuts[i]:cuts[i + 1]], source[cuts[i]:cuts[i + 1]]
        own = base[part[s]]
        out.append((int(base[i]), None, None, None, _pack(at[r]), _pack(own), _pack(own + at[s] - at[r])))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out) if out else [[]] * 7, types)})


def _stretches(table: pa.Table) -> pa.Table:
    """Stretches of one slice: windows next to each other whose names are next to each other. Documents (n = 0)
    come along, with their number of words."""
    head = [i for i, x in enumerate(table.column("ids")) if x.is_valid][0]
    cell = lambda name, i: _unpack(table.column(name)[i].as_buffer())
    base = table.column("base")[0].as_py()
    ids, marks, words = (cell(c, head) for c in ("ids", "marks", "words"))
    first = np.concatenate([[0], np.cumsum(words)])
    none = np.zeros(0, np.int64)
    at, source_base, source = [none], [none], [none]
    for i in range(table.num_rows):
        if i != head:
            at.append(cell("at", i))
            source_base.append(cell("source_base", i))
            source.append(cell("source", i) + at[-1])
    at, source_base, source = np.concatenate(at), np.concatenate(source_base), np.concatenate(source)
    order = np.argsort(at)
    at, source_base, source = at[order], source_base[order], source[order]
    # windows that the slice holds more than once: the name of the first, or its own coordinate
    more, refer = cell("at", head), cell("source", head)
    doc = lambda p: np.searchsorted(first, p, "right") - 1
    if len(more):
        k = np.minimum(np.searchsorted(at, refer), max(0, len(at) - 1))
        named = at[k] == refer if len(at) else np.zeros(len(refer), bool)
        own = named | (ids[doc(more)] > ids[doc(refer)])
        where = lambda x, y: np.where(named, x[k], y) if len(at) else y
        more_base, more_source = where(source_base, np.full(len(more), base)), where(source, base + refer)
        at = np.concatenate([at, more[own]])
        source_base = np.concatenate([source_base, more_base[own]])
        source = np.concatenate([source, more_source[own]])
        order = np.argsort(at)
        at, source_base, source = at[order], source_base[order], source[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(source) != 1)])) if len(at) else none
    n = np.diff(np.append(begin, len(at)))
    d = doc(at[begin])
    empty = np.zeros(len(ids), np.int64)
    cols = {"id": (ids[d], ids), "mark": (marks[d], marks), "words": (words[d], words), "start": (at[begin] - first[d], empty),
            "base": (np.full(len(d), base), empty + base), "at": (base + at[begin], base + first[:-1]), "n": (n, empty),
            "source_base": (source_base[begin], empty), "source": (source[begin], empty)}
    return pa.table({c: pa.array(np.concatenate(v), pa.int32() if c == "words" else pa.int64()) for c, v in cols.items()})


def _named_windows(docs: DataFrame, width: int, bucket_windows: int, slice_bytes: int, salt: int) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / 6 / bucket_windows))
    packed = docs.filter("id is not null").sortWithinPartitions("id", "mark").mapInArrow(
        _windows(width, buckets, salt, slice_bytes), _PACKED)
    named = packed.groupBy("route").applyInArrow(_name, _NAMED)
    return named.groupBy("base").applyInArrow(_stretches, _STRETCH)


# ---------------------------------------------------------------- compaction
def _lines(stretches: DataFrame) -> DataFrame:
    """base, p, end: maximal intervals of words' numbers whose windows are vertices named there."""
    shapes = stretches.groupBy(F.col("source_base").alias("base"), F.col("source").alias("p")).agg(
        F.max(F.col("source") + F.col("n")).alias("end"))
    before = Window.partitionBy("base").orderBy("p")
    apart = F.coalesce(F.col("p") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = shapes.withColumn("new", apart.cast("int")).withColumn(
        "line", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("base", "line").agg(F.min("p").alias("p"), F.max("end").alias("end")).drop("line")


def _edges(stretches: DataFrame, lines: DataFrame) -> DataFrame:
    """ub, u, vb, v: edges from a vertex u to a vertex v that is not next to it on its line (b: bases)."""
    begin = stretches.select("base", F.col("at").alias("w"), F.col("source_base").alias("vb"), F.col("source").alias("v"))
    end = stretches.select("base", (F.col("at") + F.col("n")).alias("w"), F.col("source_base").alias("ub"),
                           (F.col("source") + F.col("n") - 1).alias("u"))
    line_begin = lines.select("base", F.col("p").alias("w"), F.col("base").alias("vb"), F.col("p").alias("v"))
    line_end = lines.select("base", F.col("end").alias("w"), F.col("base").alias("ub"), (F.col("end") - 1).alias("u"))
    ends, begins = end.unionByName(line_end), begin.unionByName(line_begin)
    return ends.join(begins, ["base", "w"]).filter("v <> u + 1").select("ub", "u", "vb", "v").distinct()


def _paths(stretches: DataFrame) -> DataFrame:
    """base, p, end, path: nonbranching paths, cut into intervals of lines."""
    lines = written(_lines(stretches))
    edges = written(_edges(stretches, lines))
    cuts = edges.select(F.col("ub").alias("base"), (F.col("u") + 1).alias("p")).unionByName(
        edges.select(F.col("vb").alias("base"), F.col("v").alias("p")))
    points = lines.unionByName(cuts.withColumn("end", F.lit(None).cast("long"))).groupBy("base", "p").agg(
        F.max("end").alias("line_end"))
    order = Window.partitionBy("base").orderBy("p")
    points = points.withColumns({
        "inner": F.col("line_end").isNull(), "next": F.lead("p").over(order),
        "end": F.max("line_end").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    pieces = points.filter("p < end").select("base", "p", F.least("end", "next").alias("end"), "inner")
    pieces = written(pieces)
    # edges along a line at its cuts count as well
    along = pieces.filter("inner").select((F.col("p") - 1).alias("u"), F.col("p").alias("v"))
    every = edges.select("u", "v").unionByName(along)
    out = every.groupBy("u").count().filter("count = 1").select("u")
    into = every.groupBy("v").count().filter("count = 1").select("v")
    only = edges.select("u", "v").join(out, "u").join(into, "v")
    links = only.join(pieces.select((F.col("end") - 1).alias("u"), F.col("p").alias("a")), "u").select(
        "a", F.col("v").alias("b"))
    labels = connected_components(links).select(F.col("node").alias("p"), "label").distinct()
    return pieces.drop("inner").join(labels, "p", "left").select("base", "p", "end", F.coalesce("label", "p").alias("path"))


def _blocks(begin: Column, end: Column) -> Column:
    """Blocks of words' numbers that an interval touches."""
    return F.explode(F.sequence(F.shiftright(begin, _NEAR), F.shiftright(end - 1, _NEAR)))


def _occurrences(stretches: DataFrame, paths: DataFrame) -> DataFrame:
    """id, mark, start, n (windows), path, source (the first window's name): pieces of stretches, path by path."""
    given = stretches.select("id", "mark", "start", F.col("source").alias("s"), (F.col("source") + F.col("n")).alias("e"),
                             _blocks(F.col("source"), F.col("source") + F.col("n")).alias("block"))
    lines = paths.select("p", "end", "path", _blocks(F.col("p"), F.col("end")).alias("block"))
    both = given.join(lines, "block").filter("p < e and s < end")
    begin = F.greatest("p", "s")
    # a pair that meets in several blocks counts in the first of them
    both = both.filter(F.shiftright(begin, _NEAR) == F.col("block"))
    return both.select("id", "mark", (F.col("start") + begin - F.col("s")).alias("start"),
                       (F.least("end", "e") - begin).alias("n"), "path", begin.alias("source"))


# ---------------------------------------------------------------- verification
def _span_digests(width: int):
    @F.arrow_udf("array<string>")
    def digests(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts in batches:
            out = []
            for a, b in slices(texts):
                words = words_of(texts.slice(a, b - a), lower=False)
                for i in range(b - a):
                    f = int(words.first[i])
                    out.append([hashlib.sha256(words.text(f + s, f + s + width)).hexdigest() for s in starts[a + i].as_py()])
            yield pa.array(out, pa.list_(pa.string()))
    return digests


def _differs(docs: DataFrame, stretches: DataFrame, places: DataFrame, width: int) -> bool:
    """Whether a single window differs from the one it is named by."""
    single = stretches.filter("n = 1").select("id", "mark", "start", "source")
    asked = single.select("source").distinct().withColumn("block", F.shiftright("source", _NEAR))
    held = places.select("id", "mark", "at", "words", _blocks(F.col("at"), F.col("at") + F.col("words")).alias("block"))
    sources = asked.join(held, "block").filter("at <= source and source < at + words").select(
        "id", "mark", (F.col("source") - F.col("at")).alias("start"), "source")
    wanted = single.unionByName(sources).groupBy("id", "mark").agg(
        F.collect_list(F.struct("start", "source")).alias("wanted"))
    wanted = written(wanted)
    n = wanted.count()
    if not n:
        return False
    if n <= SENT_IDS:
        docs = docs.join(F.broadcast(wanted.select("id")), "id", "left_semi")
    found = docs.join(wanted.hint("merge"), ["id", "mark"]).select(
        F.explode(F.arrays_zip(F.col("wanted.source").alias("source"), _span_digests(width)(
            F.col("text"), F.col("wanted.start")).alias("sha"))).alias("f"))
    return not found.groupBy("f.source").agg(F.min("f.sha").alias("x"), F.max("f.sha").alias("y")).filter("x <> y").isEmpty()


# ---------------------------------------------------------------- the operator
def _rows(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    require(documents, id_col, text)
    return documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("mark"),
                            F.col(text).cast("string").alias("text"))


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                   bucket_windows: int = BUCKET_WINDOWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Occurrences of repeated paths in documents with a greater id than the source's: id, mark (hash of the text),
    start (word, from 0), n (windows, so n + width - 1 words), path (number of its first vertex) and source
    (number of the first window's first word in the corpus)."""
    docs = _rows(documents, id_col, text)
    salt = 0
    while True:
        found = written(_named_windows(docs, width, bucket_windows, slice_bytes, salt))
        stretches, places = found.filter("n > 0"), found.filter("n = 0")
        if not _differs(docs, stretches, places, width):
            break
        salt += 2
    return _occurrences(stretches, written(_paths(stretches)))


def _without(texts: pa.Array, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    words = words_of(texts, lower=False)
    change = np.zeros(len(words.key) + 1, np.int64)
    filled = spans.fill_null([]) if spans.null_count else spans
    flat, sizes = filled.flatten(), pa.compute.list_value_length(filled).to_numpy()
    at = np.repeat(words.first[:-1], sizes)
    np.add.at(change, at + flat.field("start").to_numpy(), 1)
    np.add.at(change, at + flat.field("end").to_numpy(), -1)
    keep = np.cumsum(change[:-1]) == 0
    gone = np.concatenate([[0], np.cumsum(~keep)])[words.first]
    return np.diff(words.first), np.diff(gone), words.joined(keep)


def without_spans(text: Column, spans: Column) -> Column:
    """struct(n_words, n_removed, kept): a text's words, joined by one blank, without those in ``spans``
    (array<struct<start, end>> in words, null: none)."""
    @F.arrow_udf("n_words long, n_removed long, kept string")
    def remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, cut in batches:
            parts = [_without(texts.slice(a, b - a), cut.slice(a, b - a)) for a, b in slices(texts)]
            none = np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([
                pa.array(np.concatenate([p[0] for p in parts] or [none]), pa.int64()),
                pa.array(np.concatenate([p[1] for p in parts] or [none]), pa.int64()),
                pa.concat_arrays([p[2] for p in parts] or [pa.array([], pa.string())])], ["n_words", "n_removed", "kept"])
    # not deterministic for the planner, which else copies the call into each expression on its result
    return remove.asNondeterministic()(text.cast("string"), spans)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                   **sizes: int) -> DataFrame:
    """``documents`` with a struct column ``cut`` (another name if there is one): n_words, n_removed and kept, the words
    outside all windows that start in a document with a smaller id too. It is the last column."""
    (cut, by_id, by_mark) = fresh(documents, "cut", "by_id", "by_mark")
    spans = repeated_spans(documents, id_col, text, width, **sizes).groupBy("id", "mark").agg(F.collect_set(F.struct(
        "start", (F.col("start") + F.col("n") + F.lit(width - 1)).alias("end"))).alias("spans"))
    spans = spans.select(F.col("id").alias(by_id), F.col("mark").alias(by_mark), "spans")
    own = documents.withColumn(cut, F.col(text).cast("string"))
    here = (F.col(id_col).cast("long") == F.col(by_id)) & (F.xxhash64(cut) == F.col(by_mark))
    # spans grow with the corpus: joined by shuffle at every size
    both = own.join(spans.withColumnRenamed("spans", fresh(own, "spans")[0]).hint("merge"), here, "left")
    return both.withColumn(cut, without_spans(F.col(cut), F.col(both.columns[-1]))).select(*documents.columns, cut)
