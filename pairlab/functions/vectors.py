"""Vector expressions on ``array<double>`` columns.

These are JVM-side higher-order-function expressions, used where only a
bounded number of pairs is scored (aligned pairs, fill draws, in-batch loss).
The all-pairs work goes through the block kernel in ``operators.blocks``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(a: Column) -> Column:
    """Unit-norm vector; a zero vector stays zero.

    The squared norm is the accumulator of one ``aggregate`` and the finish
    lambda divides by it, so the norm is computed once per row (a norm
    referenced inside ``transform`` would be re-evaluated per element)."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x,
                       lambda acc: F.when(acc > 0, F.transform(a, _divide_by(F.sqrt(acc)))).otherwise(a))


def _divide_by(n: Column):
    return lambda x: x / n


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either side has zero norm."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def clamp(c: Column, lo: float = 0.001, hi: float = 1.0) -> Column:
    """min(max(c, lo), hi)."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def weighted_sum(terms) -> Column:
    """sum_i w_i * v_i over aligned vectors, summed left to right;
    ``terms`` = [(weight Column, vector Column), ...] with at least two terms."""
    (w0, v0), (w1, v1), rest = terms[0], terms[1], terms[2:]
    acc = F.zip_with(v0, v1, lambda x, y: w0 * x + w1 * y)
    for w, v in rest:
        acc = F.zip_with(acc, v, _add_scaled(w))
    return acc


def _add_scaled(w: Column):
    return lambda s, z: s + w * z


def _aligned(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Which rows have two vectors of one length, and those as matrices."""
    ok = np.fromiter(((x is not None and y is not None and len(x) > 0 and len(x) == len(y))
                      for x, y in zip(a, b)), dtype=bool, count=len(a))
    if not ok.any():
        return ok, None, None
    return ok, *(np.vstack(x[ok].to_numpy()).astype(np.float64) for x in (a, b))


def _euclid_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    ok, A, B = _aligned(a, b)
    out = np.full(len(a), np.nan)
    if A is not None:
        out[ok] = np.sqrt(((A - B) ** 2).sum(axis=1))
    return pd.Series(out).astype(object).where(ok, None)


def _cosine_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    ok, A, B = _aligned(a, b)
    if A is not None:
        na = np.sqrt((A * A).sum(axis=1))
        nb = np.sqrt((B * B).sum(axis=1))
        dot = (A * B).sum(axis=1)
        den = na * nb
        out[ok] = np.where(den > 0, dot / np.where(den > 0, den, 1.0), 0.0)
    res = pd.Series(out)
    res[~ok] = None
    return res


def cosine_rows(a: Column, b: Column) -> Column:
    """C1 for many aligned pairs: an Arrow-batched pandas UDF (numpy row-wise
    dot) -- far cheaper per row than interpreted higher-order functions.
    NULL when a vector is missing, 0.0 when a norm is zero."""
    global _COS_UDF
    if _COS_UDF is None:
        _COS_UDF = F.pandas_udf(_cosine_batch, "double")
    return _COS_UDF(a, b)


def euclid_rows(a: Column, b: Column) -> Column:
    """Euclidean distance of many aligned pairs, as ``cosine_rows``; NULL when a vector is missing."""
    global _EUCLID_UDF
    if _EUCLID_UDF is None:
        _EUCLID_UDF = F.pandas_udf(_euclid_batch, "double")
    return _EUCLID_UDF(a, b)


_COS_UDF = _EUCLID_UDF = None
