"""N-gram Jaccard self-join with signature trees.

A document is the set of its distinct word shingles, kept as 64-bit keys; documents with one set are one node.

1. Candidates. Two linked sets of at most m shingles differ in at most k = (100 - p) * 2m / (100 + p) of them
   (p: ``percent``), so of k + 1 + e parts into which a hash deals all shingles, e + 1 at least are the same in
   both. A node has a mark for each part that is not empty. If at most e of one node's parts are empty, a common
   part is not, and linked nodes have a common mark. A node with more empty parts has all its shingles dealt
   to parts once more, by another hash, until it has at most e; of two linked nodes the one that stops first has
   a common mark with the other, which has dealt in that way too. Where parts would be small (p below 85), a part of
   a set that is not small is three cells and has a mark for each two of them: it takes two differing shingles to spoil a part, so half the
   parts do, and a mark stands for four times the shingles. m is the limit of the node's size class (and also
   of the next class where it may be linked with a larger set). Marks go by hash to tasks of about ``BUCKET_TEXT``
   bytes of text, once for each slice of texts. Nodes with a common mark are connected through the smallest of
   them, never pair by pair, and components of that graph are the groups in which links are sought: every link
   lies inside a group.
2. Signature trees. The sets of a group are leaves of a tree whose nodes hold OR- and AND-combined token bitmaps
   and size ranges. A dual traversal goes down from pairs of nodes and prunes those whose sizes differ too
   much, whose greatest possible overlap is too small, or all of whose members are in one class already.
   What remains is verified exactly, and a link joins two classes (union-find), so a group of m near copies
   costs about m verifications and not m^2.
3. Sets of groups beyond ``block_bytes`` are thinned first: a set linked with another shares p percent of its own
   shingles at least, so one with fewer shingles that any other set of such groups has is linked with nothing. The rest
   are grouped by their marks again. A group that is still too large is cut into blocks. Blocks are joined within
   themselves, then the classes' representatives across blocks, then whatever is not of the group's largest class
   against all blocks, which completes the pairs; these go in rounds, so that the copies of a round are no more than
   ``ROUND_COPIES`` times the sets.
4. Components of the links give the classes over all documents.

Two different sets share a key with probability below n^2 / 2^64 for n documents, as do two shingles.

Results for odd input: a null or empty text, or one without words, has the empty set and is linked with
nothing (component_id is its own doc_id); repeated rows and ids each get a row, and rows of one id with
different texts may be in different components; a row without an id has the component_id of the rows with its
set, and null if there are none; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, passing, require, written
from .components import connected_components
from .tokens import chain, mix, slices, words_of

SHINGLE, PERCENT = 3, 90
CLASS_RATIO = 1.5         # sizes in one class
SENT_KEYS = 2_000_000     # keep_one: up to a quarter of so many rows to leave out are broadcast
SPARE = 4                 # a part that may be empty for so many that may differ
TRIPLES = 60              # sizes beyond which a part may be three cells
BUCKET_TEXT = 6 << 20     # bytes of text whose marks one task compares
BLOCK_BYTES = 8 << 20     # bytes of sets handled by one task at a time
SEND_BYTES = 32 << 20     # tables up to this size are broadcast, larger ones are joined by a shuffle
ROUND_COPIES = 2          # copies of a large group's sets that one round of block pairs makes
SET_BYTES = 512           # what a set takes besides its shingle keys: bitmaps, array headers
_FAN, _BITS, _STEP = 16, 1024, 2048


# ---------------------------------------------------------------- sets of shingles
def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text its distinct shingle keys in ascending order."""
    words = words_of(texts)
    keys = words.key.copy()
    for k in range(1, size):
        keys = chain(keys[:max(0, len(keys) - 1)], words.key[k:])
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(keys[a:b - size + 1]))
        elif b > a:  # the whole sequence as one
            key = np.array([b - a], np.uint64)
            for k in range(a, b):
                key = chain(key, words.key[k:k + 1])
            out.append(key)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(items: np.ndarray) -> int:
    """Key of a set (0: empty)."""
    if not len(items):
        return 0
    parts = mix(items)
    both = chain(np.array([parts.sum()], np.uint64), np.array([np.bitwise_xor.reduce(parts)], np.uint64))
    return int(both.view(np.int64)[0]) or 1


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _sets_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of slices of a batch with columns id, text."""
    for a, b in slices(batch.column(1)):
        yield batch.column(0).slice(a, b - a).to_pylist(), shingle_sets(batch.column(1).slice(a, b - a), size)


def _describe(size: int):
    """Rows (id, mark, key, n) of documents with columns id, text, mark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, sets in _sets_of(batch, size):
                marks = batch.column(2).slice(at, len(ids)).to_pylist()
                at += len(ids)
                yield _batch(["id", "mark", "key", "n"], ids, marks, [set_key(s) for s in sets], [len(s) for s in sets])
    return run


def part_marks(items: np.ndarray, percent: int) -> np.ndarray:
    """Marks of a set's parts; two linked sets have one in common at least."""
    n, low, out = len(items), 1, []
    while (high := max(low + 1, math.ceil(low * CLASS_RATIO))) <= n:  # sizes of a class: low to high - 1
        low = high
    classes = [high]
    if 100 * n >= percent * high:  # may be linked with a set of the next class
        classes.append(max(high + 1, math.ceil(high * CLASS_RATIO)))
    for limit in classes:
        differ = (100 - percent) * 2 * (limit - 1) // (100 + percent)
        triples = limit > TRIPLES and 100 + percent < 12 * (100 - percent)  # parts of single shingles tell little
        spoilt = differ // 2 if triples else differ
        spare = 1 + spoilt // SPARE if differ else 0
        parts, deal, empty = spoilt + 1 + spare, 0, spare + 1
        cells = 3 * parts if triples else parts
        while empty > spare:  # deal once more: see 1. above
            mixed = mix(items + np.uint64(deal)) if deal else items
            cell = (mixed >> np.uint64(32)) % np.uint64(cells)
            order = np.argsort(cell, kind="stable")
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(items[order]), out=sums[1:])
            cuts = np.searchsorted(cell[order], np.arange(cells + 1, dtype=np.uint64))
            held, content = cuts[1:] > cuts[:-1], sums[cuts[1:]] - sums[cuts[:-1]]
            name = chain(np.full(cells, limit + (deal << 40), np.uint64), np.arange(cells, dtype=np.uint64))
            if triples:  # two cells of three
                content = chain(content, np.roll(content.reshape(-1, 3), 1, axis=1).ravel())
                held = held | np.roll(held.reshape(-1, 3), 1, axis=1).ravel()
                empty = int((~held.reshape(-1, 3).all(axis=1)).sum())
            else:
                empty = int((~held).sum())
            out.append(chain(name, content)[held])
            deal += 1
    return np.concatenate(out)


def _marks(size: int, percent: int, buckets: int):
    """Marks of a slice's sets by bucket (route: its number): each mark once, with the least key that has it; the other
    keys are edges to that key (route: negative)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets_of(batch, size):
                own = {set_key(s): s for s in sets if len(s)}
                if own:
                    keys = np.sort(np.fromiter(own, np.int64))
                    yield _mark_rows(keys, [part_marks(own[k], percent) for k in keys.tolist()], buckets)
    return run


def _mark_rows(keys: np.ndarray, parts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    marks, at = np.concatenate(parts), np.repeat(np.arange(len(keys)), [len(p) for p in parts])
    order = np.argsort(marks, kind="stable")  # equal marks by key
    marks, at = marks[order], at[order]
    lead = np.concatenate([[True], marks[1:] != marks[:-1]])
    least = at[lead][np.cumsum(lead) - 1]
    edges = np.unique(np.stack([at, least], axis=1)[at != least], axis=0)
    rows = [(-1 - int(marks[0] % np.uint64(buckets)), keys[edges[:, 0]].tobytes(), keys[edges[:, 1]].tobytes(), None)]
    marks, at = marks[lead], at[lead]
    bucket = (mix(marks) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((at, bucket))
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        mine = by[cuts[i]:cuts[i + 1]]
        held, n = np.unique(at[mine], return_counts=True)
        rows.append((i, marks[mine].tobytes(), keys[held].tobytes(), n.astype(np.uint32).tobytes()))
    return _routed(rows)


_ROUTED = "route long, marks binary, keys binary, n binary"


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows), [pa.int64(), pa.binary(), pa.binary(), pa.binary()])], ["route", "marks", "keys", "n"])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def _mark_edges(table: pa.Table) -> pa.Table:
    """Edges (a, b) from keys with a common mark to the least of them."""
    if table.column("route")[0].as_py() < 0:
        edges = np.stack([_joined(table, c, np.int64) for c in ("marks", "keys")], axis=1)
    else:
        marks = _joined(table, "marks", np.uint64)
        keys = np.repeat(_joined(table, "keys", np.int64), _joined(table, "n", np.uint32))
        order = np.argsort(marks, kind="stable")
        there = marks[order]
        same = there[1:] == there[:-1]
        rows = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        del order, there, same
        rows = rows[np.lexsort((keys[rows], marks[rows]))]
        marks, keys = marks[rows], keys[rows]
        lead = np.concatenate([[True], marks[1:] != marks[:-1]])[:len(marks)]
        edges = np.stack([keys, keys[lead][np.cumsum(lead) - 1]], axis=1)
    edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]})


# ---------------------------------------------------------------- shingles that several sets have
def _set_slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(keys, sets) of slices of a batch with columns key, items."""
    for a, b in slices(batch.column("items")):
        yield batch.column("key").slice(a, b - a).to_numpy(), [
            np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("items").slice(a, b - a)]


def _shingles(buckets: int):
    """Shingles of a slice's sets by bucket (route: its number), with the key of their set; those of several sets of the slice go once,
    without a key (0), and are counted here (route: negative)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sets in _set_slices(batch):
                items, at = np.concatenate(sets), np.repeat(np.arange(len(keys)), [len(s) for s in sets])
                order = np.argsort(items, kind="stable")
                items, at = items[order], at[order]
                lead = np.concatenate([[True], items[1:] != items[:-1]])
                several = ~(lead & np.concatenate([lead[1:], [True]]))
                n = np.bincount(at[several], minlength=len(keys))
                rows = [(-1 - int(items[0] % np.uint64(buckets)), None, keys[n > 0].tobytes(), n[n > 0].astype(np.uint32).tobytes())]
                owner = np.where(several, 0, keys[at])[lead]
                items = items[lead]
                bucket = (mix(items) % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((owner, bucket))
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = by[cuts[i]:cuts[i + 1]]
                    held, n = np.unique(owner[mine], return_counts=True)
                    rows.append((i, items[mine].tobytes(), held.tobytes(), n.astype(np.uint32).tobytes()))
                yield _routed(rows)
    return run


def _shared(table: pa.Table) -> pa.Table:
    """key, n: how many of a set's shingles another set has too, of those of one bucket."""
    keys, n = _joined(table, "keys", np.int64), _joined(table, "n", np.uint32)
    if table.column("route")[0].as_py() >= 0:
        items, keys = _joined(table, "marks", np.uint64), np.repeat(keys, n)
        order = np.argsort(items, kind="stable")
        items = items[order]
        same = items[1:] == items[:-1]
        again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        keys, n = keys[again], np.ones(len(again), np.int64)
        keys, n = keys[keys != 0], n[keys != 0]
    held, at = np.unique(keys, return_inverse=True)
    return pa.table({"key": held, "n": np.bincount(at, n, len(held)).astype(np.int64)})


def _set_marks(percent: int, buckets: int):
    """``_marks`` of sets that are there already: columns key, items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sets in _set_slices(batch):
                order = np.argsort(keys)
                yield _mark_rows(keys[order], [part_marks(sets[i], percent) for i in order.tolist()], buckets)
    return run


# ---------------------------------------------------------------- signature trees
def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    marks = np.zeros((len(sets), _BITS), bool)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    marks[rows, (np.concatenate(sets) % np.uint64(_BITS)).astype(int)] = True
    return np.packbits(marks, axis=1).view(np.uint64)


class SignatureTree:
    """Levels from the leaves up; a node covers ``_FAN`` consecutive nodes of the level below."""

    def __init__(self, sets: list[np.ndarray], keys: np.ndarray):
        lead = np.array([mix(s).min() for s in sets], np.uint64)
        order = np.argsort(lead, kind="stable")  # sets with a common least element come together
        self.sets, self.keys = [sets[i] for i in order], keys[order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        bits = np.concatenate([_bitmaps(self.sets[i:i + _STEP]) for i in range(0, len(sets), _STEP)])
        self.levels = [(bits, bits, self.size, self.size)]
        while len(self.levels[-1][0]) > 1:
            some, every, low, high = self.levels[-1]
            cut = np.arange(0, len(some), _FAN)
            self.levels.append((np.bitwise_or.reduceat(some, cut), np.bitwise_and.reduceat(every, cut),
                                np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def span(self, level: int, node: int) -> tuple[int, int]:
        return node * _FAN ** level, min(len(self.sets), (node + 1) * _FAN ** level)

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * _FAN, min(len(self.levels[level - 1][0]), (node + 1) * _FAN))


def _may_link(left, i: np.ndarray, right, j: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of node pairs that may hold a link. Elements in all sets of one node that no set of the other has
    cannot be shared: |A and B| <= |A| - missing, and a link needs (100 + p) |A and B| >= p (|A| + |B|)."""
    (some_l, every_l, low_l, high_l), (some_r, every_r, low_r, high_r) = left, right
    count = lambda x: np.bitwise_count(x).sum(axis=2, dtype=np.int64)
    lost_l = count(every_l[i][:, None, :] & ~some_r[j][None, :, :])
    lost_r = count(every_r[j][None, :, :] & ~some_l[i][:, None, :])
    out = 100 * high_l[i][:, None] - (100 + percent) * lost_l >= percent * low_r[j][None, :]
    return out & (100 * high_r[j][None, :] - (100 + percent) * lost_r >= percent * low_l[i][:, None])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def join_trees(one: SignatureTree, two: SignatureTree | None, classes: dict[int, int], percent: int) -> list:
    """Links (key, key) that join classes, between two trees or within one. ``classes``: class of each key so
    far. Pairs already of one class are not looked at."""
    other = two if two is not None else one
    names = {k: i for i, k in enumerate(dict.fromkeys(
        classes.get(int(k), int(k)) for k in np.concatenate([one.keys, other.keys])))}
    group = lambda tree: np.array([names[classes.get(int(k), int(k))] for k in tree.keys])
    of_one = group(one)
    of_two = of_one if two is None else group(other)
    links: list[tuple[int, int]] = []
    todo = [(len(one.levels) - 1, 0, len(other.levels) - 1, 0)]
    while todo:
        x, i, y, j = todo.pop()
        (a, b), (c, d) = one.span(x, i), other.span(y, j)
        first = of_one[a]
        if (of_one[a:b] == first).all() and (of_two[c:d] == first).all():
            continue
        if x == 0 and y == 0:
            if (two is not None or i < j) and _linked(one.sets[i], other.sets[j], percent):
                links.append((int(one.keys[i]), int(other.keys[j])))
                old, new = of_two[j], of_one[i]
                of_one[of_one == old] = new
                of_two[of_two == old] = new
            continue
        rows = one.children(x, i) if x >= y else np.array([i])
        cols = other.children(y, j) if y >= x else np.array([j])
        down, across = x - (x >= y), y - (y >= x)
        may = _may_link(one.levels[down], rows, other.levels[across], cols, percent)
        pairs = [(int(rows[r]), int(cols[s])) for r, s in zip(*np.nonzero(may))]
        if two is None:
            pairs = [p for p in pairs if p[0] <= p[1]]
            pairs.sort(key=lambda p: p[0] != p[1], reverse=True)  # a node with itself is popped first
        todo += [(down, r, across, s) for r, s in pairs]
    return links


_LINKS = "a long, b long"


def _read_sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]


def _join_groups(percent: int):
    """Links within each group of a task's table with columns grp, key, items."""
    def run(table: pa.Table) -> pa.Table:
        groups, keys = table.column("grp").to_numpy(), table.column("key").to_numpy()
        sets, links = _read_sets(table), []
        order = np.argsort(groups, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            if len(rows) > 1:
                links += join_trees(SignatureTree([sets[r] for r in rows], keys[rows]), None, {}, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()),
                         "b": pa.array([y for _, y in links], pa.int64())})
    return run


def _join_blocks(percent: int):
    """Links between a block and a chunk of its group, both with columns key, label, items."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links = []
        if left.num_rows and right.num_rows:
            classes = {k: v for t in (left, right) for k, v in zip(t.column("key").to_pylist(),
                                                                   t.column("label").to_pylist())}
            trees = [SignatureTree(_read_sets(t), t.column("key").to_numpy()) for t in (left, right)]
            links = join_trees(*trees, classes, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()),
                         "b": pa.array([y for _, y in links], pa.int64())})
    return run


# ---------------------------------------------------------------- the join
def _candidate_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """node, label: groups of nodes that share marks."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(volume / BUCKET_TEXT))
    packed = docs.mapInArrow(_marks(size, percent, buckets), _ROUTED)
    return connected_components(packed.groupBy("route").applyInArrow(_mark_edges, _LINKS))


def _sent(table: DataFrame) -> DataFrame:
    """A table of a few numbers a row, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() * 32 <= SEND_BYTES else table


def _group_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """grp, key, items for each of ``nodes`` (node, id, label): the set of a row that has this id and this key. A row given
    twice gives its set twice."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, sets in _sets_of(batch, size):
                grp, node = (batch.column(c).slice(at, len(ids)) for c in (2, 3))
                at += len(ids)
                here = np.array([set_key(s) for s in sets], np.int64) == node.to_numpy()
                yield pa.RecordBatch.from_arrays([grp.filter(pa.array(here)), node.filter(pa.array(here)), pa.array(
                    [sets[r].tobytes() for r in np.flatnonzero(here)], pa.binary())], ["grp", "key", "items"])
    chosen = docs.join(_sent(nodes), "id").select("id", "text", "label", "node")
    return chosen.mapInArrow(pick, "grp long, key long, items binary")


def _weight(items: Column) -> Column:
    return F.length(items) + F.lit(SET_BYTES)


def _sizes(sets: DataFrame, block_bytes: int) -> DataFrame:
    """grp, bytes, n, blocks of the groups of several sets."""
    sizes = sets.groupBy("grp").agg(F.sum(_weight(F.col("items"))).alias("bytes"), F.count(F.lit(1)).alias("n"))
    return written(sizes.filter("n > 1").withColumn("blocks", F.ceil(F.col("bytes") / block_bytes).cast("int")))


def _large_bytes(sizes: DataFrame) -> int:
    return sizes.filter("blocks > 1").agg(F.sum("bytes")).first()[0] or 0


def _thinned(sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """``sets`` (grp, key, items), those of large groups without what can have no link, in groups made anew; again as long as
    that halves them."""
    sizes = _sizes(sets, block_bytes)
    volume = _large_bytes(sizes)
    while volume:
        large = sizes.filter("blocks > 1").select("grp")
        there = sets.join(_sent(large), "grp", "left_semi").select("key", "items")
        buckets = max(1, math.ceil(volume / BUCKET_TEXT))
        split = there.mapInArrow(_shingles(buckets), _ROUTED).groupBy("route").applyInArrow(_shared, "key long, n long")
        shared = written(split.groupBy("key").agg(F.sum("n").alias("n")))
        kept = there.join(_sent(shared), "key").filter(F.col("n") * 800 >= F.length("items") * percent).select("key", "items")
        packed = kept.mapInArrow(_set_marks(percent, buckets), _ROUTED)
        groups = written(connected_components(packed.groupBy("route").applyInArrow(_mark_edges, _LINKS)))
        named = groups.select(F.col("node").alias("key"), F.col("label").alias("to"))
        again = there.join(_sent(named), "key").select(F.col("to").alias("grp"), "key", "items")
        # groups are named by keys of their sets, in either way, so that those of small groups are of others
        sets = written(sets.join(_sent(large), "grp", "left_anti").select("grp", "key", "items").unionByName(again))
        sizes, before = _sizes(sets, block_bytes), volume
        volume = _large_bytes(sizes)
        if 2 * volume > before:
            break
    return sets


def _links(sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links (a, b) that connect all linked sets. ``sets``: grp, key, items."""
    sizes = _sizes(sets, block_bytes)
    total = sizes.agg(F.sum("bytes").alias("bytes"), F.max("blocks").alias("blocks")).first()
    tasks = max(1, math.ceil((total["bytes"] or 0) / block_bytes))
    placed = sets.join(_sent(sizes.select("grp", "blocks")), "grp").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # small groups are packed into tasks; a block of a large group is a task of its own
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.xxhash64("grp", "block"))
    inner = placed.withColumns({"task": task, "large": F.col("blocks") > 1})
    links = inner.groupBy("large", "task").applyInArrow(_join_groups(percent), _LINKS)
    if (total["blocks"] or 0) <= 1:
        return links
    links = written(links)
    large = placed.filter("blocks > 1")
    labels = written(connected_components(links)).withColumnRenamed("node", "key")
    named = large.join(_sent(labels), "key", "left").withColumn("label", F.coalesce("label", "key"))
    # representatives of the blocks' classes, joined in blocks again as long as there are several
    heads = named.filter("key = label").select("grp", "key", "items")
    across = written(_links(heads, percent, block_bytes) if _shrinks(heads, large) else heads.limit(0).select(
        F.col("key").alias("a"), F.col("key").alias("b")))
    links = written(links.unionByName(across))
    labels = written(connected_components(links)).withColumnRenamed("node", "key")
    # tables of keys only: the shingles stay where they are
    names = written(large.select("grp", "key", "blocks", _weight(F.col("items")).alias("weight"))
                    .join(_sent(labels), "key", "left").withColumn("label", F.coalesce("label", "key")))
    # all pairs that remain have a member outside the group's largest class
    most = names.groupBy("grp", "label").count().groupBy("grp").agg(
        F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = written(names.join(_sent(written(most)), "grp").filter("label <> main").select("grp", "key", "weight", "label", "blocks"))
    chunks = written(rest.groupBy("grp", "blocks").agg(F.ceil(F.sum("weight") / block_bytes).cast("int").alias("chunks")))
    # a round's copies: those of the left sets by chunks, of the right ones by blocks
    copies = chunks.agg(F.sum(2 * F.col("blocks").cast("long") * F.col("chunks"))).first()[0] or 0
    rounds = max(1, math.ceil(copies * block_bytes / (ROUND_COPIES * total["bytes"])))
    chunks = _sent(chunks.select("grp", "chunks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = large.join(_sent(names.select("key", "label")), "key").join(chunks, "grp").select(
        "grp", "block", every("chunks").alias("chunk"), "key", "label", "items")
    right = large.join(_sent(rest.select("key", "label")), "key").join(chunks, "grp").select(
        "grp", every("blocks").alias("block"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int")
        .alias("chunk"), "key", "label", "items")
    right = right.toDF(*right.columns)  # columns of its own, both sides come from one table
    by = ["grp", "block", "chunk"]
    for turn in range(rounds):
        now = F.pmod(F.xxhash64(*by), F.lit(rounds)) == turn
        last = left.filter(now).groupBy(*by).cogroup(right.filter(now).groupBy(*by)).applyInArrow(_join_blocks(percent), _LINKS)
        links = links.unionByName(written(last) if rounds > 1 else last)
    return links


def _shrinks(heads: DataFrame, large: DataFrame) -> bool:
    return 2 * heads.count() <= large.count()


def _components(documents: DataFrame, id_col: str, text: str, size: int, percent: int, block_bytes: int) -> DataFrame:
    """id, mark (hash of the text), n, component for each row of ``documents``."""
    require(documents, id_col, text)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = written(docs.withColumn("mark", F.xxhash64("text")).mapInArrow(
        _describe(size), "id long, mark long, key long, n long"))
    groups = written(_candidate_groups(docs, size, percent))
    classes = written(rows.filter("key <> 0").groupBy("key").agg(F.min("id").alias("id")))
    nodes = written(classes.select(F.col("key").alias("node"), "id").join(groups, "node").filter("id is not null"))
    sets = _group_sets(docs, nodes, size)
    twice = rows.filter("key <> 0 and id is not null").groupBy("id", "key").count().filter("count > 1")
    sets = written(sets if twice.isEmpty() else sets.dropDuplicates(["key"]))
    sets = _thinned(sets, percent, block_bytes)
    labels = connected_components(_links(sets, percent, block_bytes)).withColumnRenamed("node", "key")
    classes = classes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = classes.groupBy("label").agg(F.min("id").alias("component"))
    named = classes.join(least, "label").select("key", "component")
    return rows.join(named, "key", "left").select(
        "id", "mark", "n", F.when(F.col("key") == 0, F.col("id")).otherwise(F.col("component")).alias("component"))


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE,
                       percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``documents``: its id, n_shingles, and component_id, the smallest id reachable
    by links between documents whose sets have a Jaccard similarity of ``percent`` / 100 or more."""
    return _components(documents, id_col, text, size, percent, block_bytes).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE,
             percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` without those linked to one with a smaller id: one row of each component
    stays. Rows given twice (same id and text) stay once; rows without an id all stay."""
    with passing(documents.sparkSession):  # the tables of the join go with it
        rows = keep(_components(documents, id_col, text, size, percent, block_bytes))
    by_id, by_mark = fresh(documents, "by_id", "by_mark")

    def among(some: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = written(keys.select(F.col("id").alias(by_id), F.col("mark").alias(by_mark)).distinct())
        keys = F.broadcast(keys) if keys.count() <= SENT_KEYS // 4 else keys
        here = (some[id_col].cast("long") == keys[by_id]) & (F.xxhash64(some[text]) == keys[by_mark])
        return some.join(keys, here, how)
    kept = among(documents, rows.filter("id <> component"), "left_anti")
    twice = rows.filter("id is not null").groupBy("id", "mark").count().filter("count > 1")
    if twice.isEmpty():
        return kept
    return among(kept, twice, "left_anti").unionByName(among(kept, twice, "left_semi").dropDuplicates([id_col, text]))
