"""Blocked all-pairs similarity kernel (J1-J3, M1-M7 selection, R1 keys).

Layout
------
* Both sides are packed where they lie: each partition is put in order and
  cut into blocks of at most ``target_block`` / ``left_block`` rows by
  ``mapInPandas``, without a shuffle. A block's number is its partition and
  its place there, a left row's internal number its block and place, so
  ids may be negative, sparse or repeated on either side. (Ordering makes
  the blocks the same if a task runs again.)
* If the exact byte size of the packed targets is below ``broadcast_limit``
  they are broadcast: a left block meets all target blocks in consecutive
  rows of one task, and its result is final there. Above the limit the pairs
  are laid on a G x H grid: left blocks go to one of G groups and are copied
  to H target groups, target blocks go to one of H groups and are copied to G
  left groups, and the equi-join on (left group, target group) yields G*H
  tasks, as many as keep a task at ``TASK_SCORES`` scores and ``TASK_PAIRS`` pairs. G and H minimise the copied volume N*H + M*G. Each task
  emits a partial top-n, and these are always merged by the left row's
  internal number (a window planned as a partial and a final
  ``WindowGroupLimit``), whatever tasks AQE makes of the join.
* Inside a task the scores of a block pair are one float64 matrix product of
  unit vectors, one row for each distinct anchor of the left block; its rows
  (training pairs) share the scores. A task holds the scores of one pair at a
  time (small target blocks are scored together) and looks at ``ENTRIES`` of
  them in one step, for all specs that ask for high scores in common. Rows that
  have their n entries pass over what cannot be among them. Only the
  selected entries (top-n by a key, or edges above a threshold) leave the
  task. The full N x M score set is never materialised nor shuffled.
* A block's vectors lie in a cap: a center and the greatest angle to it. No
  score of a pair is above the cosine of the centers' angle less both caps;
  pairs whose bound is below the threshold (or, where only entries are asked,
  below the smallest entry kept by each row) are passed over.
* A dictionary that is searched often is packed once (``packed_targets``).

Selection keys (larger wins, ties by target id ascending)
  rank      raw cosine (search and top-K mining)
  weighted  ln(u)/w with w the clamped score: Efraimidis-Spirakis keys, the
            n largest are a weighted draw without replacement
  uniform   -u: a uniform draw without replacement
u comes from ``hashrand.pair_unit_np`` of the 62-bit hashes of row and target id.

Eligibility per (row, target): not excluded (target text equals the row's
excluded text), ``score > above`` (strict, search), ``clamped >= min_score``,
``clamped >= lo_row`` (per-row bound, e.g. the true pair's score) and
``clamped <= max_score`` (the beta cap). ``n_pool`` counts non-excluded
targets, ``n_eligible`` eligible ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashrand as hr
from ..session import materialize

CLAMP_LO, CLAMP_HI = 0.001, 1.0

TARGET_BLOCK_SCHEMA = ("tb long, n int, ids binary, th binary, hh binary, "
                       "texts array<string>, vecs binary, center binary, reach double")
LEFT_BLOCK_SCHEMA = ("lb long, n int, na int, owner binary, keys binary, vecs binary, center_l binary, "
                     "reach_l double, xh binary, xv binary, xt array<string>, lo binary, rh binary, "
                     "xs_off binary, xs_h binary, xs_t array<string>")
TOP_SCHEMA = ("uid long, spec int, key long, n_eligible long, n_pool long, ids array<long>, "
              "texts array<string>, raw array<double>, val array<double>")
EDGE_SCHEMA = "key long, target_id long, text string, raw double"

MAX_LEFT_BLOCK = 2048   # a row's internal number is its block's number times this plus its place
DEFAULT_LEFT_BLOCK = 1024
DEFAULT_TARGET_BLOCK = 2048
DEFAULT_BROADCAST_LIMIT = 256 * 1024 * 1024
TASK_SCORES, TASK_PAIRS = 1 << 29, 1 << 15   # scores, and pairs of blocks, of one cell of the grid


@dataclass(frozen=True)
class KernelSpec:
    mode: str = "rank"              # rank | weighted | uniform | edges
    n: int = 5                      # entries kept per row (not for edges)
    clamp: bool = False             # eligibility / weights on clamped scores
    min_score: float = -math.inf    # inclusive, on the (clamped) score
    above: float | None = None      # strict, on the raw score
    max_score: float = math.inf     # inclusive, on the (clamped) score
    use_row_lo: bool = False        # per-row inclusive bound column ``lo``
    hash: int = 0                   # which of the row's hashes (``rh``) draws
    counts: bool = True             # n_eligible must be exact (else only the entries must)


# ------------------------------------------------------------------ packing
def _unit_rows(mat: np.ndarray) -> np.ndarray:
    nrm = np.sqrt((mat * mat).sum(axis=1))
    out = mat.copy()
    nz = nrm > 0
    out[nz] /= nrm[nz, None]
    return out


def _stack(vectors, dim: int) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, dim), dtype=np.float64)
    mat = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    if mat.shape[1] != dim:
        raise ValueError(f"vector dimension {mat.shape[1]} != {dim}")
    return mat


def _block_numbers():
    """Numbers of this task's blocks: the partition's number, then a count."""
    from pyspark import TaskContext
    ctx = TaskContext.get()
    n = (ctx.partitionId() if ctx is not None else 0) << 30
    while True:
        yield n
        n += 1


def _cap(mat: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction and the greatest angle between it and a row of ``mat``."""
    center = mat.sum(axis=0)
    size = float(np.sqrt(center @ center))
    if not size:
        return center, math.pi
    center /= size
    return center, math.acos(max(-1.0, min(1.0, float((mat @ center).min()))))


def _pack_targets_fn(dim: int, block: int):
    def pack(batches):
        numbers = _block_numbers()
        for pdf in batches:
            for start in range(0, len(pdf), block):
                part = pdf.iloc[start:start + block]
                ids = part["corpus_id"].to_numpy(np.int64)
                mat = _unit_rows(_stack(part["embedding"].tolist(), dim))
                center, reach = _cap(mat)
                yield pd.DataFrame({
                    "tb": [next(numbers)], "n": [len(ids)], "ids": [ids.tobytes()],
                    "th": [part["th"].to_numpy(np.int64).tobytes()], "hh": [hr.wide_np(ids).tobytes()],
                    "texts": [part["text"].tolist()], "vecs": [mat.tobytes()], "center": [center.tobytes()],
                    "reach": [reach]})
    return pack


def _anchor_cuts(new: np.ndarray, block: int) -> list[int]:
    """Block borders: at most ``block`` rows, not inside an anchor's rows unless they alone are more."""
    starts, cuts, n = np.flatnonzero(new), [0], len(new)
    while cuts[-1] < n:
        end = cuts[-1] + block
        if end < n:
            begin = int(starts[np.searchsorted(starts, end, "right") - 1])
            end = begin if begin > cuts[-1] else end
        cuts.append(min(n, end))
    return cuts


def _pack_left_fn(dim: int, block: int):
    """Rows next to each other with equal vectors are one anchor: its vector is packed, and scored, once."""
    def pack(batches):
        numbers = _block_numbers()
        for pdf in batches:
            every = _unit_rows(_stack(pdf["vec"].tolist(), dim))
            new = np.ones(len(pdf), bool)
            new[1:] = (every[1:] != every[:-1]).any(axis=1)
            cuts = _anchor_cuts(new, block)
            for start, end in zip(cuts[:-1], cuts[1:]):
                part = pdf.iloc[start:end]
                n = end - start
                first = np.union1d([0], np.flatnonzero(new[start:end]))
                mat = every[start:end][first]
                owner = np.searchsorted(first, np.arange(n), "right") - 1
                center, reach = _cap(mat)
                keys = part["key"].to_numpy(np.int64)
                xv = part["xv"].to_numpy(bool)
                xh = part["xh"].to_numpy(np.int64)
                lo = part["lo"].astype("float64").fillna(np.inf).to_numpy(np.float64)
                rh = np.array(part["rh"].tolist(), np.int64)
                xt = [t if isinstance(t, str) else None for t in part["xt"].tolist()]
                # extra excluded texts per row (J10), flattened with offsets
                sets = [list(x) if x is not None else [] for x in part["xs"].tolist()]
                off = np.zeros(n + 1, dtype=np.int64)
                off[1:] = np.cumsum([len(x) for x in sets])
                xs_t = [t for x in sets for t in x]
                xs_h = np.asarray([h for x in part["xsh"].tolist() if x is not None for h in x],
                                  dtype=np.int64)
                yield pd.DataFrame({
                    "lb": [next(numbers)], "n": [n], "na": [len(mat)], "owner": [owner.tobytes()],
                    "keys": [keys.tobytes()], "vecs": [mat.tobytes()], "center_l": [center.tobytes()],
                    "reach_l": [reach], "xh": [xh.tobytes()],
                    "xv": [xv.astype(np.uint8).tobytes()], "xt": [xt],
                    "lo": [lo.tobytes()], "rh": [rh.tobytes()], "xs_off": [off.tobytes()],
                    "xs_h": [xs_h.tobytes()], "xs_t": [xs_t]})
    return pack


# ------------------------------------------------------------------ kernel
class _RowState:
    """Running top-n entries of one left block: one line a row, best first, unused places without an id."""

    __slots__ = ("lb", "keys", "n_elig", "n_pool", "size", "ids", "txt", "raw", "val")

    def __init__(self, lb: int, keys: np.ndarray, n: int):
        rows = len(keys)
        self.lb = lb
        self.keys = keys
        self.n_elig = np.zeros(rows, dtype=np.int64)
        self.n_pool = np.zeros(rows, dtype=np.int64)
        self.size = np.zeros(rows, dtype=np.int64)
        self.ids = np.zeros((rows, n), dtype=np.int64)
        self.txt = np.full((rows, n), None, dtype=object)
        self.raw = np.zeros((rows, n), dtype=np.float64)
        self.val = np.zeros((rows, n), dtype=np.float64)

    def least(self) -> np.ndarray:
        """For each row the value that an entry needs to be kept: the smallest kept one once ``n`` are, before
        that minus infinity."""
        n = self.val.shape[1]
        if not n:
            return np.full(len(self.keys), np.inf)
        return np.where(self.size == n, self.val[:, -1], -np.inf)

    def merge(self, r, ids, places, raw, val, texts):
        """Entries (row, id, place among ``texts``, raw score, value): the rows they touch keep their best."""
        n = self.val.shape[1]
        may = val >= self.least()[r]
        if not may.all():
            r, ids, places, raw, val = r[may], ids[may], places[may], raw[may], val[may]
        if not len(r):
            return
        order = np.lexsort((ids, -val, r))
        order = order[_rank_within(r[order]) < n]
        r, ids, places, raw, val = r[order], ids[order], places[order], raw[order], val[order]
        rows = np.unique(r)
        held, at = np.nonzero(np.arange(n) < self.size[rows][:, None])
        held = rows[held]
        new = np.fromiter(texts.take(places), dtype=object, count=len(places))
        r, ids = np.concatenate([held, r]), np.concatenate([self.ids[held, at], ids])
        raw, val = np.concatenate([self.raw[held, at], raw]), np.concatenate([self.val[held, at], val])
        txt = np.concatenate([self.txt[held, at], new])
        order = np.lexsort((ids, -val, r))
        place = _rank_within(r[order])
        order, place = order[place < n], place[place < n]
        r = r[order]
        self.ids[r, place], self.txt[r, place] = ids[order], txt[order]
        self.raw[r, place], self.val[r, place] = raw[order], val[order]
        self.size[rows] = np.bincount(r, minlength=len(self.keys))[rows]

    def batch(self, spec: int) -> pa.RecordBatch:
        rows = len(self.keys)
        kept = np.arange(self.val.shape[1]) < self.size[:, None]
        ends = pa.array(np.r_[0, np.cumsum(self.size)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[kept], t)) for x, t in (
            (self.ids, pa.int64()), (self.txt, pa.string()), (self.raw, pa.float64()), (self.val, pa.float64()))]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.lb * MAX_LEFT_BLOCK + np.arange(rows)), pa.array(np.full(rows, spec, np.int32)),
             pa.array(self.keys), pa.array(self.n_elig), pa.array(self.n_pool), *lists],
            ["uid", "spec", "key", "n_eligible", "n_pool", "ids", "texts", "raw", "val"])


def _rank_within(sorted_groups: np.ndarray) -> np.ndarray:
    n = len(sorted_groups)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    starts = np.r_[0, np.flatnonzero(np.diff(sorted_groups)) + 1]
    counts = np.diff(np.r_[starts, n])
    return np.arange(n) - np.repeat(starts, counts)


class _Record:
    """A row of an Arrow batch: binary values are views of the batch, lists stay Arrow arrays."""

    __slots__ = ("cols", "i")

    def __init__(self, cols: dict, i: int):
        self.cols, self.i = cols, i

    def __getitem__(self, name: str):
        value = self.cols[name][self.i]
        if isinstance(value, (pa.BinaryScalar, pa.LargeBinaryScalar)):
            return value.as_buffer()
        return value.values if isinstance(value, (pa.ListScalar, pa.LargeListScalar)) else value.as_py()


def _records(batch) -> list:
    if isinstance(batch, pd.DataFrame):
        return batch.to_dict("records")
    cols = dict(zip(batch.schema.names, batch.columns))
    return [_Record(cols, i) for i in range(batch.num_rows)]


class _Texts:
    """Texts of target blocks that lie behind each other; only those asked for become Python objects."""

    def __init__(self, parts: list):
        parts = [p if isinstance(p, pa.Array) else pa.array(list(p), pa.string()) for p in parts]
        self.all = parts[0] if len(parts) == 1 else pa.chunked_array(parts)

    def take(self, places) -> list:
        return self.all.take(pa.array(places, pa.int64())).to_pylist()

    def column(self, places) -> pa.Array:
        found = self.all.take(pa.array(places, pa.int64()))
        return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


@dataclass
class _Pair:
    """A left block and a target block."""
    row: dict
    dim: int

    def excluded(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, target) places of excluded texts, by row then target."""
        row, nt = self.row, len(ids)
        xv = np.flatnonzero(np.frombuffer(row["xv"], dtype=np.uint8))
        off = np.frombuffer(row["xs_off"], dtype=np.int64)
        if not len(xv) and not off[-1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.concatenate([xv, np.repeat(np.arange(len(owner)), np.diff(off))])
        hashes = np.concatenate([np.frombuffer(row["xh"], dtype=np.int64)[xv],
                                 np.frombuffer(row["xs_h"], dtype=np.int64)])
        th = np.frombuffer(row["th"], dtype=np.int64)
        order = np.argsort(th, kind="stable")
        a, b = (np.searchsorted(th[order], hashes, side) for side in ("left", "right"))
        hit = np.repeat(np.arange(len(hashes)), b - a)
        if not len(hit):
            return hit, hit
        cc = order[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(len(hit))]
        xt, xs_t, n = _Texts([row["xt"]]), _Texts([row["xs_t"]]), len(xv)
        own = hit < n
        mine = np.empty(len(hit), dtype=object)
        mine[own], mine[~own] = xt.take(xv[hit[own]]), xs_t.take(hit[~own] - n)
        same = mine == np.fromiter(_Texts([row["texts"]]).take(cc), dtype=object, count=len(cc))
        out = np.unique(rows[hit[same]] * nt + cc[same])
        return out // nt, out % nt

    def bound(self) -> float:
        """No score of the pair is above this: the blocks' vectors lie in caps around their centers."""
        c, d = (np.frombuffer(self.row[k], dtype=np.float64) for k in ("center", "center_l"))
        angle = math.acos(max(-1.0, min(1.0, float(c @ d)))) - self.row["reach"] - self.row["reach_l"]
        return math.cos(max(0.0, angle)) + 1e-6 if angle < math.pi else 1.0  # acos is rough near 1


class _Chunk:
    """A left block and the target blocks that are scored with it at once: what does not depend on the spec.
    Its score matrix goes with it, so that a task holds one at a time, whatever a batch holds."""

    def __init__(self, pairs: list[_Pair], dim: int):
        row = pairs[0].row
        self.dim, self.rows = dim, [p.row for p in pairs]
        self.owner = np.frombuffer(row["owner"], dtype=np.int64)
        self.lo = np.frombuffer(row["lo"], dtype=np.float64)
        self.rh = np.frombuffer(row["rh"], dtype=np.int64).reshape(len(self.owner), -1)
        ids = [np.frombuffer(r["ids"], dtype=np.int64) for r in self.rows]
        starts = np.r_[0, np.cumsum([len(x) for x in ids])]
        out = [p.excluded(x, self.owner) for p, x in zip(pairs, ids)]
        self.ids, self.nt = np.concatenate(ids), int(starts[-1])
        self.hh = np.concatenate([np.frombuffer(r["hh"], dtype=np.int64) for r in self.rows])
        self.texts = _Texts([r["texts"] for r in self.rows])
        self.known = np.sort(np.concatenate([xr * self.nt + at + xc for at, (xr, xc) in zip(starts, out)]))
        self.xr, self.xc = self.known // max(1, self.nt), self.known % max(1, self.nt)
        self._scores = None

    @property
    def scores(self) -> np.ndarray:
        """Anchors x targets, computed once a chunk and only if some spec needs it."""
        if self._scores is None:
            V = np.frombuffer(self.rows[0]["vecs"], dtype=np.float64).reshape(-1, self.dim)
            T = [np.frombuffer(r["vecs_t"], dtype=np.float64).reshape(-1, self.dim) for r in self.rows]
            self._scores = V @ (T[0] if len(T) == 1 else np.concatenate(T)).T
        return self._scores

    def excluded_at(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(rows), bool)
        want = rows * self.nt + cols
        return self.known[np.minimum(np.searchsorted(self.known, want), len(self.known) - 1)] == want


def _clamped(spec: KernelSpec, scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, CLAMP_LO, CLAMP_HI) if spec.clamp else scores


def _eligible(spec: KernelSpec, S: np.ndarray) -> np.ndarray:
    """Eligibility by score alone (not by the row's own bound and excluded texts)."""
    if spec.above is None and spec.clamp and spec.min_score <= CLAMP_LO and spec.max_score >= CLAMP_HI:
        return S == S  # every number
    C = _clamped(spec, S)
    elig = np.ones(S.shape, dtype=bool)
    if spec.above is not None:
        elig &= S > spec.above
    if spec.min_score > -math.inf:
        elig &= C >= spec.min_score
    if spec.max_score < math.inf:
        elig &= C <= spec.max_score
    return elig


def _floor(spec: KernelSpec) -> float:
    """No raw score below this is eligible."""
    floor = -math.inf if spec.above is None else spec.above
    if spec.clamp and spec.min_score <= CLAMP_LO:
        return floor
    return max(floor, min(spec.min_score, CLAMP_HI) if spec.clamp else spec.min_score)


def _nothing_above(spec: KernelSpec, bound: float, state: "_RowState | None") -> bool:
    """Whether a pair without scores above ``bound`` gives this spec nothing."""
    if spec.above is not None and bound <= spec.above:
        return True
    if bound < spec.min_score and not (spec.clamp and spec.min_score <= CLAMP_LO):
        return True
    return spec.mode == "rank" and not spec.counts and state is not None and bound < state.least().min(initial=np.inf)


def _expand(owner: np.ndarray, na: int, aa: np.ndarray, cc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (anchor, target), sorted by anchor, for each of the anchor's rows: (row, target, place of the entry)."""
    first = np.searchsorted(aa, np.arange(na + 1))
    size = np.diff(first)[owner]
    rows = np.repeat(np.arange(len(owner)), size)
    at = np.repeat(first[owner] - (np.cumsum(size) - size), size) + np.arange(len(rows))
    return rows, cc[at], at


def _turns(batch, dim: int):
    """A batch's pairs with their bounds, by left block (they lie together); a left block's pairs with the greatest
    bound first, so that its best entries are known early. (Results do not depend on the order.)"""
    turn: list = []
    for row in _records(batch):
        pair = _Pair(row, dim)
        if turn and int(row["lb"]) != int(turn[0][0].row["lb"]):
            yield sorted(turn, key=lambda x: -x[1])
            turn = []
        turn.append((pair, pair.bound()))
    if turn:
        yield sorted(turn, key=lambda x: -x[1])


def _kernel_fn(specs: list[KernelSpec], dim: int, skipped: list | None = None):
    """``skipped`` (tests): gets, for each block pair, whether it was passed over without scores."""
    edges = specs[0].mode == "edges"

    def run(batches):
        current_lb, states = None, []
        for batch in batches:
            for turn in _turns(batch, dim):
                left = turn[0][0].row
                keys = np.frombuffer(left["keys"], dtype=np.int64)
                if not edges and int(left["lb"]) != current_lb:
                    yield from (state.batch(i) for i, state in enumerate(states))
                    current_lb = int(left["lb"])
                    states = [_RowState(current_lb, keys.copy(), spec.n) for spec in specs]
                owner = np.frombuffer(left["owner"], dtype=np.int64)
                # small target blocks are scored together, the first ones alone so that others may be passed over
                at, together = 0, 1
                while at < len(turn):
                    chunk, targets = [], 0
                    while at < len(turn) and len(chunk) < together and targets < CHUNK_TARGETS:
                        pair, bound = turn[at]
                        at += 1
                        asked = [not _nothing_above(s, bound, states[i] if states else None) for i, s in enumerate(specs)]
                        if skipped is not None:
                            skipped.append(not any(asked))
                        if any(asked):
                            chunk.append(pair)
                            targets += int(pair.row["n_t"])
                        elif not edges:
                            ids = np.frombuffer(pair.row["ids"], dtype=np.int64)
                            pool = len(ids) - np.bincount(pair.excluded(ids, owner)[0], minlength=len(owner))
                            for state in states:
                                state.n_pool += pool
                    together *= 2
                    if not chunk:
                        continue
                    block = _Chunk(chunk, dim)
                    if edges:
                        yield from _edges_of(block, specs[0], keys)
                    else:
                        pool = block.nt - np.bincount(block.xr, minlength=len(owner))
                        for state in states:
                            state.n_pool += pool
                        _select(block, specs, states)
                    del block
        yield from (state.batch(i) for i, state in enumerate(states))

    return run


CHUNK_TARGETS = 1024     # target blocks are scored together until they have so many rows
ENTRIES = 1 << 16        # scores that one step looks at; their arrays stay in a core's cache
PAIR_CUT = 0.02          # share of pairs above which a draw's bound is taken from each pair's own score


def _slices(n: int, width: int):
    """Ranges of rows (or anchors) with about ``ENTRIES`` scores."""
    step = max(1, ENTRIES // max(1, width))
    return ((a, min(n, a + step)) for a in range(0, n, step))


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix that is mostly false."""
    at = np.flatnonzero(mask)
    rows = at // max(1, mask.shape[1])
    return rows, at - rows * mask.shape[1]


def _joined(parts: list) -> tuple:
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _listed(chunk: _Chunk, specs: list[KernelSpec], floors: np.ndarray):
    """Entries (row, target, raw score) of at least their anchor's floor, but for excluded texts, a part of the
    rows at a time; few entries of several parts come together. ``floors``: one an anchor."""
    waiting, n = [], 0
    for part in _listed_parts(chunk, specs, floors):
        waiting.append(part)
        n += len(part[0])
        if n >= ENTRIES:
            yield _joined(waiting)
            waiting, n = [], 0
    if n:
        yield _joined(waiting)


def _listed_parts(chunk: _Chunk, specs: list[KernelSpec], floors: np.ndarray):
    S, owner = chunk.scores, chunk.owner
    ends = np.searchsorted(owner, np.arange(len(S) + 1))
    for a, b in _slices(len(S), S.shape[1]):
        aa, ca = _places(S[a:b] >= floors[a:b, None])
        if not len(aa):
            continue
        first = np.searchsorted(aa, np.arange(b - a + 1))
        # an anchor of many rows is expanded a part of its rows at a time
        mine = owner[ends[a]:ends[b]] - a
        size = np.cumsum(np.diff(first)[mine])
        start = 0
        while start < len(mine):
            stop = int(np.searchsorted(size, (size[start - 1] if start else 0) + 2 * ENTRIES, "right"))
            stop = min(len(mine), max(stop, start + 1))
            rr, cc, at = _expand(mine[start:stop], b - a, aa, ca)
            rr += ends[a] + start
            keep = ~chunk.excluded_at(rr, cc)
            rr, cc, at = rr[keep], cc[keep], at[keep]
            yield rr, cc, S[aa[at] + a, cc]
            start = stop


def _edges_of(chunk: _Chunk, spec: KernelSpec, keys: np.ndarray):
    floors = np.full(len(chunk.scores), _floor(spec))
    for rr, cc, raw in _listed(chunk, [spec], floors):
        keep = _eligible(spec, raw)
        if spec.use_row_lo:
            keep &= _clamped(spec, raw) >= chunk.lo[rr]
        rr, cc, raw = rr[keep], cc[keep], raw[keep]
        if len(rr):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[rr]), pa.array(chunk.ids[cc]), chunk.texts.column(cc).cast(pa.string()), pa.array(raw)],
                ["key", "target_id", "text", "raw"])


def _select(chunk: _Chunk, specs: list[KernelSpec], states: list[_RowState]) -> None:
    """Merge a chunk's best entries under each spec into the left block's states. Specs that few scores reach share
    one list of those; draws that many reach look at their keys first."""
    S, owner = chunk.scores, chunk.owner
    listed, floors = [], None
    for spec, state in zip(specs, states):
        if spec.mode not in ("rank", "weighted", "uniform"):
            raise ValueError(f"unknown kernel mode {spec.mode!r}")
        floor = np.full(len(S), _floor(spec))
        if spec.mode == "rank" and not spec.counts:
            least = np.full(len(S), np.inf)
            np.minimum.at(least, owner, state.least())
            floor = np.maximum(floor, least)
        if spec.mode == "rank" and spec.counts is False and not np.isfinite(floor).all():
            _first_ranked(chunk, spec, state)
        elif spec.mode != "rank" and np.isneginf(floor).any():
            _drawn(chunk, spec, state)
        else:
            listed.append((spec, state))
            floors = floor if floors is None else np.minimum(floors, floor)
    if not listed:
        return
    for rr, cc, raw in _listed(chunk, [s for s, _ in listed], floors):
        for spec, state in listed:
            _merge_entries(chunk, spec, state, rr, cc, raw)


def _merge_entries(chunk: _Chunk, spec: KernelSpec, state: _RowState, rr, cc, raw) -> None:
    elig = _eligible(spec, raw)
    if spec.use_row_lo:
        elig &= _clamped(spec, raw) >= chunk.lo[rr]
    rr, cc, raw = rr[elig], cc[elig], raw[elig]
    state.n_elig += np.bincount(rr, minlength=len(chunk.owner))
    if not len(rr):
        return
    val = raw
    if spec.mode != "rank":
        val = _keys(spec, raw, hr.pair_unit_np(chunk.rh[rr, spec.hash], chunk.hh[cc]))
    state.merge(rr, chunk.ids[cc], cc, raw, val, chunk.texts)


def _keys(spec: KernelSpec, raw: np.ndarray, u: np.ndarray) -> np.ndarray:
    if spec.mode == "uniform":
        return -u
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(u) / _clamped(spec, raw)


def _first_ranked(chunk: _Chunk, spec: KernelSpec, state: _RowState) -> None:
    """Best scores without counts while rows have no n entries yet: the n-th best of the chunk is each anchor's floor."""
    S = chunk.scores
    more = int(np.bincount(chunk.xr, minlength=1).max()) if len(chunk.xr) else 0
    need, floor = spec.n + more, _floor(spec)
    floors = np.full(len(S), floor)
    if S.shape[1] > need and not spec.use_row_lo and spec.max_score == math.inf:
        for a, b in _slices(*S.shape):
            may = np.where(S[a:b] >= floor, S[a:b], -np.inf)
            floors[a:b] = np.maximum(floor, np.partition(may, S.shape[1] - need, axis=1)[:, S.shape[1] - need])
    for rr, cc, raw in _listed(chunk, [spec], floors):
        _merge_entries(chunk, spec, state, rr, cc, raw)


def _drawn(chunk: _Chunk, spec: KernelSpec, state: _RowState) -> None:
    """Keyed draws from (nearly) all targets: every row has keys of its own, on scores it shares with its anchor's
    other rows. A key is at most that of the row's greatest score (or of the pair's, where that pays), so the first
    half of the hash tells for almost every target that the row has better ones. A row without n entries is asked
    for keys that about n targets reach (a few more); if fewer than n do, all its keys are computed."""
    S, owner = chunk.scores, chunk.owner
    rh, hh = chunk.rh[:, spec.hash], chunk.hh
    nt = S.shape[1]
    top = _clamped(spec, np.fmax.reduce(S, axis=1, initial=-np.inf))
    may = np.concatenate([_eligible(spec, S[a:b]) for a, b in _slices(*S.shape)]) if len(S) else np.zeros(S.shape, bool)
    every = may.all()
    if not spec.use_row_lo:
        gone = may[owner[chunk.xr], chunk.xc]
        counts = np.full(len(S), nt) if every else may.sum(axis=1)
        state.n_elig += counts[owner] - np.bincount(chunk.xr[gone], minlength=len(owner))
    if not spec.n:
        return
    cut = state.least()
    new = np.isneginf(cut)
    if new.any():
        cut = np.where(new, _guess(chunk, spec)[owner], cut)
    parts = []

    def entries(rows: np.ndarray, cols: np.ndarray, one: np.ndarray):
        """Those of the pairs that are eligible, with their scores and keys."""
        keep = ~chunk.excluded_at(rows, cols)
        if not every:
            keep &= may[owner[rows], cols]
        rows, cols, one = rows[keep], cols[keep], one[keep]
        score = S[owner[rows], cols]
        if spec.use_row_lo:
            keep = _clamped(spec, score) >= chunk.lo[rows]
            rows, cols, one, score = rows[keep], cols[keep], one[keep], score[keep]
        return rows, cols, score, _keys(spec, score, hr.joined_unit_np(one, rh[rows], hh[cols]))

    for a, b in _slices(len(owner), nt):
        one = hr.first_np(rh[a:b, None], hh[None, :])
        if spec.use_row_lo:
            near = may[owner[a:b]] & (_clamped(spec, S[owner[a:b]]) >= chunk.lo[a:b, None])
            x, y = np.searchsorted(chunk.xr, [a, b])
            near[chunk.xr[x:y] - a, chunk.xc[x:y]] = False
            state.n_elig[a:b] += near.sum(axis=1)
        rr, cc = _places(_may_reach(spec, one, cut[a:b], S, owner[a:b], top))
        part = entries(a + rr, cc, one[rr, cc])
        few = np.zeros(b - a, bool)
        if new[a:b].any():
            reached = np.bincount(part[0][part[3] >= cut[part[0]]] - a, minlength=b - a)
            few = new[a:b] & (reached < spec.n) & ~np.isneginf(cut[a:b])
        if few.any():
            keep = ~few[part[0] - a]
            parts.append(tuple(x[keep] for x in part))
            rr = np.repeat(np.flatnonzero(few), nt)
            part = entries(a + rr, np.tile(np.arange(nt), int(few.sum())), one[few].ravel())
        if len(part[0]) > 8 * spec.n * (b - a) and nt > spec.n:  # all keys of many rows: those of the n best are enough
            rr, cc, _, val = part
            keys = np.full(one.shape, -np.inf)
            keys[rr - a, cc] = val
            best = val >= np.partition(keys, nt - spec.n, axis=1)[:, nt - spec.n][rr - a]
            part = tuple(x[best] for x in part)
        parts.append(part)
    rr, cc, score, val = _joined(parts)
    state.merge(rr, chunk.ids[cc], cc, score, val, chunk.texts)


def _guess(chunk: _Chunk, spec: KernelSpec) -> np.ndarray:
    """For each anchor a key that a few more than n of the chunk's targets may be expected to reach; minus infinity
    where there are too few targets for a guess."""
    S = chunk.scores
    want = spec.n + 4 * math.sqrt(spec.n) + 4
    if S.shape[1] < 4 * want or not (spec.clamp or spec.mode == "uniform"):
        return np.full(len(S), -np.inf)
    if spec.mode == "uniform":
        return np.full(len(S), -want / S.shape[1])
    weight = np.concatenate([np.nansum(_clamped(spec, S[a:b]), axis=1) for a, b in _slices(*S.shape)])
    return -want / np.maximum(weight, CLAMP_LO)


def _may_reach(spec: KernelSpec, one: np.ndarray, cut: np.ndarray, S: np.ndarray, owner: np.ndarray,
               top: np.ndarray) -> np.ndarray:
    """Pairs whose key may be at least their row's ``cut``, by the first half of their hash: u is below (one + 1) / P,
    and a key of weight w is at least the cut only if u >= exp(cut w) >= 1 + cut w."""
    if spec.mode == "uniform":
        return one <= (np.minimum(-cut, 2.0) * hr.P + 2).astype(np.int64)[:, None]
    if not spec.clamp:
        return np.ones(one.shape, bool)
    with np.errstate(over="ignore", invalid="ignore"):
        if np.mean(np.minimum(-cut * top[owner], 1.0)) <= PAIR_CUT:
            return one >= (np.exp(cut * top[owner]) * hr.P - 2).astype(np.int64)[:, None]
        w = _clamped(spec, S[owner])
        np.multiply(w, (np.maximum(cut, -1e6) * hr.P)[:, None], out=w)
        np.add(w, hr.P - 2.0, out=w)
        near = one >= w
    near[np.isneginf(cut)] = True
    return near


# ------------------------------------------------------------------ driver
@dataclass(frozen=True)
class TargetStats:
    count: int
    dim: int
    text_bytes: int

    def packed_bytes(self) -> int:
        """Exact upper bound of the packed target blocks (vectors, ids, hashes, texts)."""
        return self.count * (self.dim * 8 + 24 + 16) + self.text_bytes


@dataclass(frozen=True)
class PackedTargets:
    """Targets packed once: blocks, and the sizes that decide how they meet the left side."""
    blocks: DataFrame
    stats: TargetStats


def target_block_rows(dim: int) -> int:
    """Rows of a target block: block rows shrink with the dimension, so a block stays around 16 MB."""
    return max(128, min(DEFAULT_TARGET_BLOCK, (16 << 20) // (8 * max(dim, 1))))


def packed_targets(targets: DataFrame, *, clusters: int = 0, target_block: int | None = None,
                   stats: TargetStats | None = None, path: str | None = None) -> PackedTargets:
    """Pack a dictionary once for many calls of the kernel. The blocks are written to ``path`` (a folder of one
    version of the dictionary, read again by ``read_packed``) or, without one, to the checkpoint folder.
    ``clusters`` > 0 puts near targets into common blocks (by the nearest of so many targets), so that more
    pairs of blocks are passed over; results do not depend on it."""
    stats = stats or target_stats(targets)
    blocks = pack_targets(targets, stats.dim, target_block or target_block_rows(stats.dim), stats.count, clusters)
    if path is None:
        return PackedTargets(materialize(blocks), stats)
    sizes = [F.lit(getattr(stats, k)).cast("long").alias(f"all_{k}") for k in ("count", "dim", "text_bytes")]
    blocks.select("*", *sizes).write.mode("overwrite").parquet(path)
    return read_packed(blocks.sparkSession, path)


def read_packed(spark, path: str) -> PackedTargets:
    """Blocks that ``packed_targets`` wrote to ``path``."""
    blocks = spark.read.parquet(path)
    row = blocks.select("all_count", "all_dim", "all_text_bytes").first()
    stats = TargetStats(*(int(x) for x in row)) if row else TargetStats(0, 0, 0)
    return PackedTargets(blocks.drop("all_count", "all_dim", "all_text_bytes"), stats)


def target_stats(targets: DataFrame) -> TargetStats:
    row = targets.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"),
                      F.sum(F.octet_length("text")).alias("tb")).collect()[0]
    return TargetStats(int(row["n"] or 0), int(row["d"] or 0), int(row["tb"] or 0))


def _nearest_pivot(pivots: np.ndarray):
    """Number of the pivot with the greatest cosine, for each vector."""
    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        return pd.Series((_unit_rows(_stack(vectors.tolist(), pivots.shape[1])) @ pivots.T).argmax(axis=1).astype("int32"))
    return nearest


def _far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, each the one that is farthest from those before."""
    if not len(vectors):
        return vectors
    at, near = [0], vectors @ vectors[0]
    while len(at) < min(n, len(vectors)):
        at.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[at[-1]])
    return vectors[at]


def pack_targets(targets: DataFrame, dim: int, block: int, count: int, clusters: int = 0) -> DataFrame:
    """Blocks of at most ``block`` targets, packed where they lie. A small table lies in too many
    partitions; they are put together (no shuffle) so that blocks are full. With ``clusters``, targets are first
    dealt by the nearest of that many targets (the pivots: far apart among four times as many that a hash chooses,
    so the driver holds at most 4,096 rows)."""
    t = targets.select(
        F.col("corpus_id").cast("long").alias("corpus_id"), "text",
        F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64("text").alias("th"))
    parts = max(1, -(-count // block))
    if clusters and count:
        clusters = min(1024, clusters)
        chosen = t.orderBy(F.xxhash64("corpus_id", "text")).limit(4 * clusters).select("embedding").collect()
        pivots = _far_apart(_unit_rows(_stack([r["embedding"] for r in chosen], dim)), clusters)
        t = t.withColumn("near", _nearest_pivot(pivots)("embedding"))
        t = t.repartitionByRange(min(parts, len(pivots)), "near").sortWithinPartitions("near", "corpus_id", "text")
        return t.drop("near").mapInPandas(_pack_targets_fn(dim, block), TARGET_BLOCK_SCHEMA)
    if count <= block * 64:
        t = t.coalesce(parts)
    return t.sortWithinPartitions("corpus_id", "text").mapInPandas(_pack_targets_fn(dim, block), TARGET_BLOCK_SCHEMA)


def similarity_kernel(left: DataFrame, targets: DataFrame | PackedTargets, spec: KernelSpec | list[KernelSpec], *,
                      left_block: int | None = None,
                      target_block: int | None = None,
                      broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
                      min_partitions: int | None = None,
                      stats: TargetStats | None = None,
                      grid_tasks: int | None = None,
                      left_spread: bool = False) -> DataFrame:
    """Run the kernel. ``left`` has ``key long, vec array<double>`` and optional
    ``xh long`` (excluded text hash), ``xt string`` (excluded text), ``xs
    array<string>`` (further excluded texts, J10), ``lo double``
    and ``rh array<long>`` (row hashes for random keys, one for each number in the specs' ``hash``) and
    ``anchor long``: rows with equal numbers come next to each other, and those of them with equal vectors are
    scored once. ``targets`` has ``corpus_id long, text string, embedding array<double>``, or is packed already.

    Returns TOP_SCHEMA rows (one per left row) or, for ``mode='edges'``,
    EDGE_SCHEMA rows (one per eligible pair). A list of specs scores every
    block pair once and returns one row per left row and spec (its place in
    the list, column ``spec``). ``left_spread=True`` tells the
    kernel that ``left`` already has enough evenly filled partitions (e.g. a
    materialized frame), which skips the balancing shuffle."""
    spark = left.sparkSession
    specs = spec if isinstance(spec, list) else [spec]
    packed = targets if isinstance(targets, PackedTargets) else None
    stats = packed.stats if packed else stats or target_stats(targets)
    cols = set(left.columns)
    lf = left.select(
        F.col("key").cast("long").alias("key"),
        F.col("vec").cast("array<double>").alias("vec"),
        F.coalesce(F.col("xh").cast("long"), F.lit(0).cast("long")).alias("xh")
        if "xh" in cols else F.lit(0).cast("long").alias("xh"),
        (F.col("xh").isNotNull() if "xh" in cols else F.lit(False)).alias("xv"),
        (F.col("xt") if "xt" in cols else F.lit(None)).cast("string").alias("xt"),
        (F.col("lo") if "lo" in cols else F.lit(None)).cast("double").alias("lo"),
        (F.col("rh") if "rh" in cols else F.array(F.lit(0))).cast("array<long>").alias("rh"),
        (F.col("anchor").cast("long") if "anchor" in cols else F.lit(0).cast("long")).alias("anchor"),
        (F.col("xs") if "xs" in cols else F.lit(None)).cast("array<string>").alias("xs"),
        (F.transform("xs", lambda t: F.xxhash64(t)) if "xs" in cols else F.lit(None))
        .cast("array<long>").alias("xsh"))
    if stats.count == 0:
        if specs[0].mode == "edges":
            return spark.createDataFrame([], EDGE_SCHEMA)
        each = F.explode(F.sequence(F.lit(0), F.lit(len(specs) - 1))).alias("spec")
        return lf.select("key", each).select("key", "spec", F.lit(0).cast("long").alias("n_eligible"),
                         F.lit(0).cast("long").alias("n_pool"),
                         F.array().cast("array<long>").alias("ids"),
                         F.array().cast("array<string>").alias("texts"),
                         F.array().cast("array<double>").alias("raw"),
                         F.array().cast("array<double>").alias("val"))
    dim = stats.dim
    _bound_arrow_batches(spark)
    # block rows shrink with the dimension so a packed block stays ~8-16 MB
    left_block = min(MAX_LEFT_BLOCK, left_block) if left_block else max(64, min(DEFAULT_LEFT_BLOCK, (8 << 20) // (8 * max(dim, 1))))
    target_block = target_block or target_block_rows(dim)
    # Spread the anchors evenly before the compute-heavy kernel. An explicit
    # partition count is kept by AQE (a small upstream shuffle would otherwise
    # be coalesced into one task); at scale this is one shuffle of the left
    # side, small next to the N x M product it balances.
    parts = min_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                  spark.sparkContext.defaultParallelism)
    if not left_spread:
        lf = lf.repartition(parts)
    local = stats.packed_bytes() <= broadcast_limit
    if not local:
        lf = materialize(lf)      # counted and packed: read once from the checkpoint folder
    tblocks = (packed.blocks if packed else pack_targets(targets, dim, target_block, stats.count)).select(
        "tb", F.col("n").alias("n_t"), "ids", "th", "hh", "texts", F.col("vecs").alias("vecs_t"), "center", "reach")
    lf = lf.sortWithinPartitions("anchor", "key") if "anchor" in cols else lf.sortWithinPartitions("key")
    lblocks = lf.drop("anchor").mapInPandas(_pack_left_fn(dim, left_block), LEFT_BLOCK_SCHEMA)
    if local:
        paired = _grid_pairs(lblocks, tblocks, 1, 1, send=True)
    else:
        n_left = lf.count()
        pairs = -(-n_left // left_block) * -(-stats.count // target_block)
        tasks = grid_tasks or max(parts, -(-n_left * stats.count // TASK_SCORES), -(-pairs // TASK_PAIRS))
        paired = _grid_pairs(lblocks, tblocks, *grid_shape(n_left, stats.count, left_block, target_block, tasks))
    if specs[0].mode == "edges":
        return paired.mapInArrow(_kernel_fn(specs, dim), EDGE_SCHEMA)
    out = paired.mapInArrow(_kernel_fn(specs, dim), TOP_SCHEMA)
    return out.drop("uid") if local else merge_partials(out, [s.n for s in specs])


def grid_shape(n_left: int, n_targets: int, left_block: int, target_block: int,
               tasks: int) -> tuple[int, int]:
    """(G, H) for the shuffle path: G left groups x H target groups, G*H ~ tasks.

    The left side is copied H times and the targets G times; with N left
    rows and M targets the copied volume N*H + M*G is smallest at
    H = sqrt(tasks * M / N)."""
    lb = max(1, -(-n_left // left_block))
    tb = max(1, -(-n_targets // target_block))
    h = int(round(math.sqrt(tasks * max(n_targets, 1) / max(n_left, 1))))
    h = max(1, min(h, tb, tasks))
    g = max(1, min(-(-tasks // h), lb))
    return g, h


def _grid_pairs(lblocks: DataFrame, tblocks: DataFrame, g: int, h: int, send: bool = False) -> DataFrame:
    """Every left block with every target block, by an equi-join on (left group, target group). The groups are
    computed values: a literal would be folded and turn the join into a nested loop."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    lg = lblocks.withColumn("lg", F.pmod(F.xxhash64("lb"), F.lit(g).cast("long"))).withColumn("tg", every(h))
    tg = tblocks.withColumn("tg", F.pmod(F.xxhash64("tb"), F.lit(h).cast("long"))).withColumn("lg", every(g))
    if send:
        return lg.join(F.broadcast(tg), ["lg", "tg"])
    # as many partitions as cells: with fewer, a task would get several cells
    cells = max(g * h, lblocks.sparkSession.sparkContext.defaultParallelism)
    return lg.repartition(cells, "lg", "tg").join(tg.repartition(cells, "lg", "tg"), ["lg", "tg"])


ARROW_BATCH_BYTES = 64 * 1024 * 1024
_UNITS = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _bytes(value) -> int | None:
    """Parse a Spark byte-size setting ("67108864b", "64m", "1g", "1024")."""
    if value is None:
        return None
    v = str(value).strip().lower()
    num = v.rstrip("kmgb")
    unit = v[len(num):] or "b"
    try:
        return int(float(num) * _UNITS[unit])
    except (ValueError, KeyError):
        return None


def _bound_arrow_batches(spark) -> None:
    """Joined kernel rows carry two packed blocks (~1 MB each); a session that
    leaves Arrow batches unbounded in bytes could build multi-GB batches.
    Bound them where the session has not chosen a bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    cur = _bytes(spark.conf.get(key, None))
    if cur is None or cur > 4 * ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def merge_partials(parts: DataFrame, n: list[int]) -> DataFrame:
    """Combine partial results of the same left row (its internal number) and spec, ``n`` entries of each spec."""
    by = ["uid", "spec"]
    counts = parts.groupBy(*by).agg(F.first("key").alias("key"), F.sum("n_eligible").alias("n_eligible"),
                                    F.sum("n_pool").alias("n_pool"))
    ent = parts.select(*by, F.explode(F.arrays_zip("ids", "texts", "raw", "val")).alias("e")) \
               .select(*by, F.col("e.ids").alias("id"), F.col("e.texts").alias("text"),
                       F.col("e.raw").alias("raw"), F.col("e.val").alias("val"))
    w = Window.partitionBy(*by).orderBy(F.desc("val"), F.asc("id"), F.asc("text"))
    top = ent.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= max(n))
    if len(set(n)) > 1:
        top = top.filter(F.col("rk") <= F.element_at(F.array(*[F.lit(x) for x in n]), F.col("spec") + 1))
    packed = top.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("rk", "id", "text", "raw", "val"))).alias("es"))
    return counts.join(packed, by, "left").select(
        "key", "spec", "n_eligible", "n_pool",
        F.coalesce(F.transform("es", lambda e: e["id"]), F.array().cast("array<long>")).alias("ids"),
        F.coalesce(F.transform("es", lambda e: e["text"]), F.array().cast("array<string>")).alias("texts"),
        F.coalesce(F.transform("es", lambda e: e["raw"]), F.array().cast("array<double>")).alias("raw"),
        F.coalesce(F.transform("es", lambda e: e["val"]), F.array().cast("array<double>")).alias("val"))
