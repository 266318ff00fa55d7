"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut at the special strings and by the public split pattern into words. The distinct words of a batch
lie in one flat symbol array; each round looks up every adjacent pair by binary search over the sorted pair
keys, takes for each word its lowest rank, and merges all its occurrences at once (left to right where they
overlap). Words without a mergeable pair leave the array. Pieces of frequent words are kept between batches in
a cache of bounded size. Decoding maps ids to bytes and reads these as UTF-8 with replacement.

The vocabulary is read once on the driver and broadcast: its size is that of the vocabulary file (some MB).

Results for odd input: null and empty texts have no ids and decode to the empty text; a text of any length is
encoded whole; repeated rows each get a row; other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .tokens import slices

_SHIFT, _FILTER = 20, 22
_NEVER = np.int64(1 << 60)
#: Distinct words whose pieces a worker keeps, and bytes of text it handles at a time.
CACHE_WORDS = 150_000
CHUNK_BYTES = 500_000


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write byte b as one printable letter: itself if printable, else 256 + n."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


@dataclass
class MergeTable:
    keys: np.ndarray      # sorted left << 20 | right
    ranks: np.ndarray
    merged: np.ndarray    # id that a pair becomes
    byte_ids: np.ndarray  # id of each of the 256 bytes
    pieces: list[bytes]   # bytes of each id
    special: dict[str, int]
    pattern: str

    def __post_init__(self):
        self.names = [str(i) for i in range(len(self.pieces))]
        self.maybe = np.zeros(1 << _FILTER, bool)  # pairs whose bit is off need no binary search
        self.maybe[self._bit(self.keys)] = True

    @staticmethod
    def _bit(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - _FILTER)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are pairs that merge, and their places in the table."""
        at = np.flatnonzero(self.maybe[self._bit(keys)])
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        right = self.keys[place] == keys[at]
        return at[right], place[right]

    @staticmethod
    def load(path: str, pattern: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            pieces[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << _SHIFT | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        ids = {b: vocab[c] for c, b in letters.items()}
        return MergeTable(keys[order], order.astype(np.int64),
                          np.array([vocab[a + b] for a, b in pairs], np.int64)[order],
                          np.array([ids[b] for b in range(256)], np.int64), pieces, special, pattern)


def merge_rounds(words: list[bytes], m: MergeTable) -> list[list[int]]:
    """The ids of each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_owner = [], []
    while len(symbols):
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        own, place = m.find(symbols[inner] << _SHIFT | symbols[inner + 1])
        rank, merged = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)
        rank[inner[own]], merged[inner[own]] = m.ranks[place], m.merged[place]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(owner)))
        over = lowest == _NEVER
        if over.any():
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
        hits = np.flatnonzero((rank == lowest) & ~over)
        # a run of adjacent hits is one symbol repeated: every second one merges
        run = np.diff(hits, prepend=-2) != 1
        since = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
        hits = hits[since % 2 == 0]
        symbols = symbols.copy()
        symbols[hits] = merged[hits]
        keep = ~over
        keep[hits + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if not done_owner:
        return [[] for _ in words]
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    ids, ends = symbols[np.argsort(owner, kind="stable")].tolist(), np.cumsum(np.bincount(owner, minlength=len(words)))
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Codec:
    """Encodes and decodes texts; one for each Python worker task."""

    def __init__(self, table: MergeTable):
        import regex
        self.table, self.kept = table, {}
        self.split = regex.compile(table.pattern).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))
                                 if table.special else r"(?!)")

    def _words(self, text: str) -> list[str]:
        if not any(s in text for s in self.table.special):
            return self.split(text)
        out, end = [], 0
        for hit in self.cut.finditer(text):
            out += self.split(text[end:hit.start()])
            out.append(hit[0])
            end = hit.end()
        return out + self.split(text[end:])

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text its words as (ids joined by commas, number of ids, decoded bytes)."""
        cut = [self._words(t) for t in texts]
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        new = list({w for words in cut for w in words if w not in self.kept})
        plain = [w for w in new if w not in self.table.special]
        for word, ids in zip(plain, merge_rounds([w.encode() for w in plain], self.table), strict=True):
            self._keep(word, ids)
        for word in new:
            if word in self.table.special:
                self._keep(word, [self.table.special[word]])
        for words in cut:
            yield [self.kept[w] for w in words]

    def _keep(self, word: str, ids: list[int]) -> None:
        names, pieces = self.table.names, self.table.pieces
        self.kept[word] = (",".join([names[i] for i in ids]), len(ids), b"".join([pieces[i] for i in ids]))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in next(self.pieces([text])) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.table.pieces[i] for i in ids]).decode("utf-8", "replace")


def _numbers(joined: str) -> np.ndarray:
    return np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32)


def _table(spark: SparkSession, path: str | None):
    import public_tokenizers
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return spark.sparkContext.broadcast(MergeTable.load(path, public_tokenizers.PATTERN))


def bpe_encode(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Ids of a text as array<int>; ``path``: a byte-level BPE vocabulary in the tokenizers format."""
    table = _table(spark, path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(table.value)
        for texts in batches:
            out = [_numbers(",".join([p[0] for p in own]))
                   for a, b in slices(texts, CHUNK_BYTES) for own in codec.pieces(texts.slice(a, b - a).to_pylist())]
            yield pa.array(out, pa.list_(pa.int32()))
    return encode(F.coalesce(text, F.lit("")))


def bpe_decode(spark: SparkSession, ids: Column, path: str | None = None) -> Column:
    """Text of array<int> ids, special tokens included; null ids give the empty text."""
    table = _table(spark, path)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(table.value)
        for rows in batches:
            yield pa.array([codec.decode(r.as_py() or []) for r in rows], pa.string())
    return decode(ids)


def bpe_digest(spark: SparkSession, text: Column, path: str | None = None, with_ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass. ``with_ids`` adds the
    ids themselves; without it they do not leave the worker."""
    table = _table(spark, path)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(table.value)
        for texts in batches:
            n, shas, decoded, ids = [], [], [], []
            for a, b in slices(texts, CHUNK_BYTES):
                for own in codec.pieces(texts.slice(a, b - a).to_pylist()):
                    n.append(sum([p[1] for p in own]))
                    joined = ",".join([p[0] for p in own])
                    shas.append(sha(joined.encode()))
                    decoded.append(sha(b"".join([p[2] for p in own]).decode("utf-8", "replace").encode()))
                    ids.append(_numbers(joined) if with_ids else None)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string()),
                 pa.array(ids, pa.list_(pa.int32()))], ["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    out = digest(F.coalesce(text, F.lit("")))
    return out if with_ids else out.dropFields("ids")
