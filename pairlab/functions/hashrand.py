"""Portable keyed randomness.

Every random choice in the engine (fill draws, weighted and uniform picks,
batch order) is a pure function of (seed, keys), never ``rand()``. A retried
task or an AQE re-plan therefore draws the same values, and the same function
is written three times -- as Spark SQL, as numpy, and as DuckDB SQL -- so
Spark jobs, in-task numpy kernels and the oracle agree bit for bit.

All arithmetic stays in signed 64-bit integers without overflow: a mixing
round maps [0, 2^31) to [0, P), P = 2^31 - 1, by ``x -> ((x xor k) * a + 1)
mod P``. A 64-bit key goes in as two words, and a hash is two independent
chains (``wide``, 62 bits), so keys that agree modulo P stay apart and a
draw reaches every position of a table of any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus, word mask, chain starts, then (xor key, multiplier) of each mixing round.
P = 2147483647
MASK = 2147483647
STARTS = (1013904223, 1376312589)
ROUNDS = (
    (1540483477, 742938285),
    (668265263, 950706376),
    (374761393, 1226874159),
    (1640531527, 62089911),
)

# Stream codes keep independent purposes apart under one seed.
STREAM_PICK = 1      # weighted / uniform pick keys of eligible targets
STREAM_FILL = 2      # positions of random fill draws
STREAM_FILL_KEY = 3  # pick keys of fill draws
STREAM_EASY = 4      # easy (uniform, whole dictionary) negatives
STREAM_BATCH = 5     # instance shuffle order
STREAM_SHORT = 6     # negatives that replace missing hard ones
ANCHOR_CODE = {"query": 100, "candidate": 200}


def _words(x: int) -> tuple[int, int]:
    if isinstance(x, bool) or not isinstance(x, int):
        raise TypeError("hash keys are integers or column names")
    return x & MASK, (x >> 31) & MASK


# ----------------------------------------------------------------- Spark SQL text
# One expression string per hash: one ``F.expr`` call instead of dozens of Column round trips.
def _sp_words(x) -> tuple[str, str]:
    if isinstance(x, str):
        return f"(CAST(`{x}` AS BIGINT) & {MASK}L)", f"(shiftright(CAST(`{x}` AS BIGINT), 31) & {MASK}L)"
    lo, hi = _words(x)
    return f"{lo}L", f"{hi}L"


def _sp_mix(x: str) -> str:
    for k, a in ROUNDS:
        x = f"((({x}) ^ {k}L) * {a}L + 1L) % {P}L"
    return x


def _sp_chain(start: int, xs) -> str:
    h = f"{start}L"
    for x in xs:
        for word in _sp_words(x):
            h = _sp_mix(f"({h}) ^ {word}")
    return h


def wide_expr(*xs) -> Column:
    """62-bit hash of a key tuple; keys are int literals or column names."""
    one, two = (_sp_chain(s, xs) for s in STARTS)
    return F.expr(f"(({one}) * {MASK + 1}L + ({two}))")


def unit(wide: Column) -> Column:
    """A 62-bit hash as a double in (0, 1)."""
    low = wide.bitwiseAND(F.lit(MASK).cast("long")).cast("double")
    return (F.shiftright(wide, 31).cast("double") + (low + F.lit(0.5)) / F.lit(float(P))) / F.lit(float(P))


def uniform_expr(*xs) -> Column:
    """u in (0, 1) of a key tuple; keys are int literals or column names."""
    return unit(wide_expr(*xs))


# ----------------------------------------------------------------- numpy
def mix_np(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype=np.int64)
    _mix_in_place(x, np.empty_like(x))
    return x[()]


def _mix_in_place(x: np.ndarray, high: np.ndarray) -> None:
    """``mix_np`` of ``x`` in its place; ``high`` is scratch of the same shape."""
    x, high = x.view(np.uint64), high.view(np.uint64)
    for k, a in ROUNDS:
        # modulo P = 2^31 - 1 by folding, in place: the two words of a number below 2^62 add up to less than 2 P
        np.bitwise_xor(x, np.uint64(k), out=x)
        np.multiply(x, np.uint64(a), out=x)
        np.add(x, np.uint64(1), out=x)
        np.right_shift(x, np.uint64(31), out=high)
        np.bitwise_and(x, np.uint64(P), out=x)
        np.add(x, high, out=x)
        np.subtract(x, np.uint64(P), out=high)  # wraps to a great number where x is below P
        np.minimum(x, high, out=x)


def wide_np(*xs) -> np.ndarray:
    out = []
    for start in STARTS:
        h = np.int64(start)
        for x in xs:
            x = np.asarray(x, dtype=np.int64)
            h = mix_np(h ^ (x & MASK))
            h = mix_np(h ^ ((x >> 31) & MASK))
        out.append(h)
    return out[0] * (MASK + 1) + out[1]


def unit_np(wide: np.ndarray) -> np.ndarray:
    return ((wide >> 31).astype(np.float64) + ((wide & MASK).astype(np.float64) + 0.5) / float(P)) / float(P)


def pair_unit_np(row_hash: np.ndarray, target_hash: np.ndarray) -> np.ndarray:
    """u of (row, target) from their 62-bit hashes, broadcasting."""
    return joined_unit_np(first_np(row_hash, target_hash), row_hash, target_hash)


def first_np(row_hash: np.ndarray, target_hash: np.ndarray) -> np.ndarray:
    """The first half of ``pair_unit_np``'s hash: u lies between this and one more, divided by P."""
    x = np.array((row_hash >> 31) ^ (target_hash >> 31), dtype=np.int64, copy=None)
    _mix_in_place(x, np.empty_like(x))
    return x[()]


def joined_unit_np(first: np.ndarray, row_hash: np.ndarray, target_hash: np.ndarray) -> np.ndarray:
    """``pair_unit_np`` from its first half."""
    return unit_np(first * (MASK + 1) + mix_np((row_hash & MASK) ^ (target_hash & MASK)))


# ----------------------------------------------------------------- DuckDB SQL text
def _mix_sql(left: str, right: str) -> str:
    x = f"xor({left}, {right})"
    for k, a in ROUNDS:
        x = f"((xor({x}, {k}::BIGINT) * {a}::BIGINT + 1) % {P})"
    return x


def _words_sql(x) -> tuple[str, str]:
    if isinstance(x, str):
        return f"(CAST({x} AS BIGINT) & {MASK}::BIGINT)", f"((CAST({x} AS BIGINT) >> 31) & {MASK}::BIGINT)"
    lo, hi = _words(x)
    return f"{lo}::BIGINT", f"{hi}::BIGINT"


def _chain_sql(start: int, xs) -> str:
    h = f"{start}::BIGINT"
    for x in xs:
        for word in _words_sql(x):
            h = _mix_sql(h, word)
    return h


def wide_sql(*xs) -> str:
    one, two = (_chain_sql(s, xs) for s in STARTS)
    return f"({one} * {MASK + 1}::BIGINT + {two})"


def unit_sql(one: str, two: str) -> str:
    p = f"{float(P)!r}::DOUBLE"
    return f"((CAST({one} AS DOUBLE) + (CAST({two} AS DOUBLE) + 0.5::DOUBLE) / {p}) / {p})"


def uniform_sql(*xs) -> str:
    return unit_sql(*(_chain_sql(s, xs) for s in STARTS))


def pair_unit_sql(row_keys: tuple, target_id: str) -> str:
    """u of (row, target): ``row_keys`` are the keys of the row's hash."""
    return unit_sql(*(_mix_sql(_chain_sql(s, row_keys), _chain_sql(s, (target_id,))) for s in STARTS))
