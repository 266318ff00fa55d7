"""Periodic runs of words: maximal stretches of consecutive words with a smallest period q, of at least
``MIN_WORDS`` words and three periods, found with multi-scale minimizers.

A stretch is looked for as words that equal the word q places on. Texts of a batch lie one after another in one
array, with a separator between them that equals nothing, so that no stretch crosses texts.

1. Periods below ``SHORT`` are too short for a window: the array is compared with itself at each such lag.
2. For every scale P = SHORT, 2 SHORT, 4 SHORT, ... (periods P to 2P - 1) every P words have a key, made from the
   keys of the scale before. Windows of P keys have minima; a run with period q has one whose image, q places
   on, is the minimum of its own window. Places with equal keys that are minima and lie P to 2P - 1 apart are
   seeds, each of which is extended both ways word by word. Only texts of 3P words or more go on to a scale.
3. P words inside a run whose period is at most P / 3 would be minima at each of that run's periods; they are
   left out. In each run of the scale some P words stay (were all of one period long left out, neighbours
   would share a short period, so the run's smallest period would be that one), which keep at least P / 3
   between equal ones. So a place has few partners, and a scale takes time linear in the words.
4. One stretch found with several periods has them all as multiples of the smallest, which is kept.

Words are compared by 64-bit keys: two different ones are equal with probability below n^2 / 2^64 for n words of
a batch. Results for odd input: a null or empty text, or one of white space, has no words and no runs, and
collapses to the empty text; texts are independent of each other, so repeated rows get equal results; a
text of any length is searched whole, in memory in proportion to its words; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import chain, mix, slices, words_of

MIN_WORDS = 24
SHORT = 16      # periods below are found by direct scans; the first scale
_LAST = np.uint64(2**64 - 1)
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _extend(y: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The greatest lo <= at < hi such that y[i] = y[i + lag] for all i in lo ... hi - 1."""
    hi, step = at, 64
    while True:
        b = y[hi + lag:hi + lag + step]
        off = np.flatnonzero(y[hi:hi + len(b)] != b)
        hi += int(off[0]) if len(off) else len(b)
        if len(off) or len(b) < step:
            break
        step *= 2
    lo, step = at, 64
    while lo:
        a = max(0, lo - step)
        off = np.flatnonzero(y[a:lo] != y[a + lag:lo + lag])
        lo = a + int(off[-1]) + 1 if len(off) else a
        if len(off):
            break
        step *= 2
    return lo, hi


def _least(length: int | np.ndarray) -> int | np.ndarray:
    """Equal pairs that a run with this period has at least."""
    return np.maximum(MIN_WORDS - length, 2 * length)


def _short_periods(y: np.ndarray, below: int) -> list[tuple[int, int, int]]:
    found = []
    for lag in range(1, min(below, len(y))):
        off = np.flatnonzero(y[:-lag] != y[lag:])
        off = np.concatenate([[-1], off, [len(y) - lag]])
        gap = np.diff(off) - 1
        for i in np.flatnonzero(gap >= _least(lag)).tolist():
            found.append((int(off[i]) + 1, int(gap[i]) + lag, lag))
    return found


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of ``width`` values; len(values) - width + 1 of them."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some window of ``width`` values; the greatest value is never one."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    least = _sliding(values, width, np.minimum)
    # the greatest minimum among the windows that hold a place equals its value
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    best = _sliding(padded, width, np.maximum)
    return np.flatnonzero((best == values) & (values != _LAST))


def _seeds(keys: np.ndarray, values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of equal minima that lie scale to 2 scale - 1 apart, in that order."""
    at = _minimizers(values, scale)
    order = np.lexsort((at, values[at]))
    at, own, out, j = at[order], values[at[order]], [], 1
    while j < len(at):
        near = (own[j:] == own[:-j]) & (at[j:] - at[:-j] < 2 * scale)
        if not near.any():
            break
        i = np.flatnonzero(near & (at[j:] - at[:-j] >= scale))
        out.append(np.stack([at[i + j] - at[i], at[i]]))
        j += 1
    lag, place = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    # the period before or after the place is inside the run as well
    top = len(keys) - 1
    before = (place >= lag) & (keys[np.maximum(place - lag, 0)] == keys[place])
    there = np.minimum(place + lag - scale, top), np.minimum(place + 2 * lag - scale, top)
    keep = np.flatnonzero(before | (keys[there[0]] == keys[there[1]]))
    keep = keep[np.lexsort((place[keep], lag[keep]))]
    return lag[keep], place[keep]


def find_runs(keys: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run, sorted; ``keys``: word keys of texts, text i has
    ``first[i]:first[i + 1]``."""
    n = np.diff(first)
    found: dict[tuple[int, int, int], int] = {}

    def keep(base: np.ndarray, texts: np.ndarray, start: int, length: int, period: int) -> None:
        i = int(np.searchsorted(base, start, "right")) - 1
        key = (int(texts[i]), int(start - base[i]), length)
        found[key] = min(period, found.get(key, period))
    texts = np.flatnonzero(n >= MIN_WORDS)
    unique = lambda k: mix(np.arange(k, dtype=np.uint64) + np.uint64(0xA5A5_0000_0000_0000))
    # words of the long enough texts, a separator after each
    size = n[texts] + 1
    base = np.cumsum(size) - size
    own = np.repeat(first[:-1][texts] - base, size) + np.arange(int(size.sum()))
    y = np.append(keys, np.uint64(0))[np.minimum(own, len(keys))] if len(texts) else np.zeros(0, np.uint64)
    y[base + size - 1] = unique(len(base))
    for start, length, period in _short_periods(y, SHORT):
        keep(base, texts, start, length, period)
    blocks, have, scale = mix(y), 1, SHORT
    while True:
        stay = n[texts] >= 3 * scale
        if not stay.any():
            break
        if not stay.all():
            rows = np.repeat(stay, size)
            y, blocks = y[rows], blocks[rows]
            texts, size = texts[stay], size[stay]
            base = np.cumsum(size) - size
        while have < scale:  # keys of 2 * have words; beyond the end nothing is equal
            after = np.concatenate([blocks[have:], unique(min(have, len(blocks)))])[:len(blocks)]
            blocks, have = chain(blocks, after), 2 * have
        values = np.minimum(mix(blocks), _LAST - np.uint64(1))
        change = np.zeros(len(y) + 1, np.int64)
        where = {int(t): int(b) for t, b in zip(texts, base)}
        for (text, start, length), period in found.items():
            if 3 * period <= scale <= length and text in where:
                change[where[text] + start] += 1
                change[where[text] + start + length - scale + 1] -= 1
        values[np.cumsum(change[:-1]) > 0] = _LAST
        done_lag, done_to = -1, -1
        for lag, at in zip(*(x.tolist() for x in _seeds(blocks, values, scale))):
            if lag == done_lag and at < done_to:
                continue
            lo, hi = _extend(y, at, lag)
            done_lag, done_to = lag, hi
            if hi - lo >= _least(lag):
                keep(base, texts, lo, hi - lo + lag, lag)
        scale *= 2
    return sorted((t, s, length, q) for (t, s, length), q in found.items())


def _search(texts: pa.Array) -> tuple[np.ndarray, list[list[dict]], pa.Array]:
    """Words, runs and the collapsed text of each text."""
    words = words_of(texts, lower=False)
    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    drop = np.zeros(len(words.key) + 1, np.int64)
    for text, start, length, period in find_runs(words.key, words.first):
        runs[text].append({"start": start, "length": length, "period": period})
        at = int(words.first[text]) + start
        drop[at + period] += 1
        drop[at + length] -= 1
    collapsed = words.joined(np.cumsum(drop[:-1]) == 0)
    return np.diff(words.first), runs, collapsed


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(text: Column) -> Column:
    """struct(n_words, runs, collapsed): the runs of a text by start and period, with ``start`` in words from 0, and its
    words joined by one blank without those that a run repeats (what lies after its first period)."""
    @F.arrow_udf(RESULT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_search(texts.slice(a, b - a)) for a, b in slices(texts)]
            yield pa.StructArray.from_arrays([
                pa.array(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)]), pa.int64()),
                pa.array([r for p in parts for r in p[1]], _RUNS),
                pa.concat_arrays([p[2] for p in parts] or [pa.array([], pa.string())])],
                ["n_words", "runs", "collapsed"])
    # not deterministic for the planner, which else copies the call into each expression on its result
    return search.asNondeterministic()(text.cast("string"))


def greatest_exponent(runs: Column) -> Column:
    """The run with the greatest length / period (compared exactly), then the least start and period; null if none."""
    def before(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(a != b, F.when(a > b, -1).otherwise(1)).when(
            x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
            F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    return F.get(F.array_sort(runs, before), F.lit(0))


def listing(runs: Column) -> Column:
    """Every run's ``start,length,period`` and a line feed."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def repeat_words(text: Column, from_word: Column, copies: Column) -> Column:
    """``text`` (words joined by one blank) in which each word from number a = ``from_word`` % n on becomes word
    a + (i - a) % p of the n original ones, p = 1 + floor((n - a) / ``copies``). Where ``from_word`` is null, and for a
    text without words, nothing is repeated."""
    @F.arrow_udf("string")
    def repeated(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, times in batches:
            parts = []
            for x, y in slices(texts):
                words = words_of(texts.slice(x, y - x), lower=False)
                chosen = np.arange(len(words.key))
                for i in range(y - x):
                    f, g, start = int(words.first[i]), int(words.first[i + 1]), starts[x + i].as_py()
                    if g > f and start is not None:
                        a = start % (g - f)
                        p = 1 + (g - f - a) // times[x + i].as_py()
                        chosen[f + a:g] = f + a + np.arange(g - f - a) % p
                parts.append(words.strings(chosen, words.first))
            yield pa.concat_arrays(parts or [pa.array([], pa.string())])
    return repeated(text.cast("string"), from_word.cast("long"), copies.cast("long"))
