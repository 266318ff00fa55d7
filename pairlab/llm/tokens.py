"""Words of Arrow string batches as numpy arrays: byte spans and 64-bit keys, without a Python string per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time (a longer single text is handled whole), and bytes hashed at a time.
CHUNK_BYTES = 2_000_000
PIECE = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)            # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a sequence that ``right`` prolongs; depends on the order."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: Words are runs of anything but ASCII white space, or runs of letters, digits and bytes beyond ASCII.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) == 1:
        for k, base in enumerate((_STEP, _BACK)):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PIECE, base, np.uint64))])
    return _POWERS[0], _POWERS[1]


def _polynomials(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of (byte + 1) * STEP^(place in the word) for each span, modulo 2^64; a piece of the bytes at a time."""
    forth, back = _powers()
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a > PIECE:  # one word longer than a piece
            total = 0
            for k, at in enumerate(range(a, b, PIECE)):
                part = raw[at:min(b, at + PIECE)].astype(np.uint64) + np.uint64(1)
                total += int((part * forth[:len(part)]).sum()) * pow(int(_STEP), k * PIECE, 1 << 64)
            out[i] = np.uint64(total % (1 << 64))
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * forth[:b - a], out=sums[1:])
            out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * back[start[i:j] - a]
        i = j
    return out


@dataclass
class Words:
    raw: np.ndarray    # (lower-cased) bytes of all texts
    start: np.ndarray  # byte span of each word
    end: np.ndarray
    key: np.ndarray    # 64-bit key of each word
    first: np.ndarray  # words of text i are first[i]:first[i + 1]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by blanks."""
        return b" ".join([self.raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])])

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The kept words (a mask) of every text, joined by one blank."""
        chosen = np.flatnonzero(keep)
        return self.strings(chosen, np.searchsorted(chosen, self.first))

    def strings(self, chosen: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """Words (by their numbers) joined by one blank: text i gets ``chosen[cuts[i]:cuts[i + 1]]``."""
        size = self.end[chosen] - self.start[chosen] + 1  # with a blank after each word
        ends = np.cumsum(size)
        at = np.repeat(self.start[chosen] - (ends - size), size) + np.arange(int(size.sum()))
        out = self.raw[np.minimum(at, max(0, len(self.raw) - 1))]
        out[ends - 1] = 32
        some = cuts[1:] > cuts[:-1]
        keep = np.ones(len(out), bool)
        keep[ends[cuts[1:][some] - 1] - 1] = False  # a text's last blank goes
        bounds = np.concatenate([[0], ends])[cuts] - np.concatenate([[0], np.cumsum(some)])
        return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()),
                                                pa.py_buffer(out[keep].tobytes())).cast(pa.string())


def words_of(texts: pa.Array, word_byte: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Words of every text (null: none), A-Z lower-cased unless ``lower`` is false."""
    texts = texts.cast(pa.large_string()).fill_null("") if not pa.types.is_large_string(texts.type) or texts.null_count \
        else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(texts) else \
        np.zeros(0, np.uint8)
    raw, bounds = _LOWER[raw] if lower else raw, offsets - offsets[0]
    inside = word_byte[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(raw))]
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    key = mix(_polynomials(raw, start, end) + (end - start).astype(np.uint64) * _STEP)
    return Words(raw, start, end, key, np.searchsorted(start, bounds))


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each, one row at least."""
    if not len(texts):
        return
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - 1) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)])
