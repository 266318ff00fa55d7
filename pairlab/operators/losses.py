"""Loss audits over assembled instances.

A6 (bidirectional in-batch ranking): a batch of B instances
``[q, hq_1..hq_Hq, c, hc_1..hc_Hc]`` gives anchors = the B true queries then
Hq blocks of hard queries, and candidates = the B true candidates then Hc
blocks of hard candidates; s = scale * cos. Forward loss of row i is
``logsumexp_c s(q_i, c) - s(q_i, c_i)`` over all (Hc+1)B candidates,
backward loss of row j is ``logsumexp_a s(a, c_j) - s(q_j, c_j)`` over all
(Hq+1)B anchors; the batch loss is the mean of both means, halved. Incoming
labels are ignored (replaced by positions), in-batch duplicates are not
masked.

The in-batch score matrix is bounded by the batch size, so each batch is
one ``groupBy(batch_id).applyInPandas`` group: the vectors of its texts are
joined in by equi-joins, the (Hq+1)B x (Hc+1)B product is one numpy matmul,
and only per-row losses leave the task -- no pair rows are emitted.

A7 is the forward half with Hq = 0 on ``[a, p, n_1..n_k]``. A8-A10 are
per-row expressions on pair / triplet instances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_rows, euclid_rows
from .similarity import vector_lookup

ROW_LOSS_SCHEMA = "batch_id long, pos int, forward double, backward double"


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    return (m + np.log(np.sum(np.exp(x - m), axis=axis, keepdims=True))).squeeze(axis)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))
    out = m.copy()
    nz = n > 0
    out[nz] /= n[nz, None]
    return out


def cosine_matrix(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _unit(a) @ _unit(c).T


def dot_matrix(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a @ c.T


def _batch_loss_fn(n_hard_queries: int, scale: float, similarity):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        # an instance with a text that has no vector, or with fewer texts than the others, is left out as a
        # whole, so that the rest stays aligned; its row comes back with null losses
        known = pdf["vec"].notna()
        n = known.groupby(pdf["pos"]).agg(["size", "sum"])
        whole = np.sort(n.index[(n["size"] == n["size"].max()) & (n["size"] == n["sum"])].to_numpy())
        every = np.sort(n.index.to_numpy())
        out = pd.DataFrame({"batch_id": np.full(len(every), int(pdf["batch_id"].iloc[0]), dtype=np.int64),
                            "pos": every.astype(np.int32), "forward": np.nan, "backward": np.nan})
        if not len(whole):
            return out
        part = pdf[pdf["pos"].isin(whole)]
        b, dim = len(whole), len(part["vec"].iloc[0])
        anchors = part[part["side"] == 0].sort_values(["blk", "pos"])
        cands = part[part["side"] == 1].sort_values(["blk", "pos"])
        A = np.vstack(anchors["vec"].to_numpy()).reshape(-1, dim).astype(np.float64)
        C = np.vstack(cands["vec"].to_numpy()).reshape(-1, dim).astype(np.float64)
        S = scale * similarity(A, C)                # ((Hq+1)B) x ((Hc+1)B)
        idx = np.arange(b)
        diag = S[idx, idx]
        kept = out["pos"].isin(whole).to_numpy()
        out.loc[kept, "forward"] = _lse(S[:b, :], axis=1) - diag    # true query i vs all candidates
        out.loc[kept, "backward"] = _lse(S[:, :b], axis=0) - diag   # true candidate j vs all anchors
        return out
    return fn


def _exploded_vectors(batched: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame,
                      n_hard_queries: int) -> DataFrame:
    ex = batched.select("batch_id", "pos", F.posexplode("texts").alias("idx", "text"))
    hq = F.lit(int(n_hard_queries))
    ex = ex.select("batch_id", "pos", "text",
                   F.when(F.col("idx") <= hq, 0).otherwise(1).alias("side"),
                   F.when(F.col("idx") <= hq, F.col("idx")).otherwise(F.col("idx") - hq - 1).alias("blk"))
    qv = vector_lookup(query_vectors).select("text", F.lit(0).alias("side"), F.col("embedding").alias("vec"))
    cv = vector_lookup(candidate_vectors).select("text", F.lit(1).alias("side"), F.col("embedding").alias("vec"))
    return ex.join(qv.unionByName(cv), ["text", "side"], "left")


def in_batch_row_losses(batched: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame,
                        n_hard_queries: int, scale: float = 20.0, similarity=cosine_matrix) -> DataFrame:
    """A6 per row: ``batch_id, pos, forward, backward`` (null for an instance with a text without a vector).

    ``batched``: ``batch_id, pos, texts`` (W5 output over I1/I2 instances). ``similarity``: a function of two
    matrices, of anchors and of candidates as rows, that returns the matrix of their scores."""
    vec = _exploded_vectors(batched, query_vectors, candidate_vectors, n_hard_queries)
    return vec.select("batch_id", "pos", "side", "blk", "vec").groupBy("batch_id") \
              .applyInPandas(_batch_loss_fn(n_hard_queries, float(scale), similarity), ROW_LOSS_SCHEMA)


def bidirectional_loss(batched: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame,
                       n_hard_queries: int, scale: float = 20.0, similarity=cosine_matrix) -> DataFrame:
    """A6 per batch: ``batch_id, n, forward, backward, loss``."""
    rows = in_batch_row_losses(batched, query_vectors, candidate_vectors, n_hard_queries, scale, similarity)
    return rows.groupBy("batch_id").agg(
        F.count("forward").alias("n"), F.avg("forward").alias("forward"),
        F.avg("backward").alias("backward")).withColumn(
        "loss", (F.col("forward") + F.col("backward")) / 2.0)


def one_way_loss(batched: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame,
                 scale: float = 20.0, similarity=cosine_matrix) -> DataFrame:
    """A7 per batch: ``batch_id, n, loss`` (forward half, no hard queries)."""
    rows = in_batch_row_losses(batched, query_vectors, candidate_vectors, 0, scale, similarity)
    return rows.groupBy("batch_id").agg(F.count("forward").alias("n"), F.avg("forward").alias("loss"))


def _pair_vectors(inst: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame,
                  n_texts: int) -> DataFrame:
    out = inst.select("instance_id", "label", *[F.col("texts")[i].alias(f"t{i}") for i in range(n_texts)])
    qv = vector_lookup(query_vectors)
    cv = vector_lookup(candidate_vectors)
    out = out.join(qv.select(F.col("text").alias("t0"), F.col("embedding").alias("v0")), "t0", "left")
    for i in range(1, n_texts):
        out = out.join(cv.select(F.col("text").alias(f"t{i}"), F.col("embedding").alias(f"v{i}")),
                       f"t{i}", "left")
    return out


def contrastive_loss(pairs_inst: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame,
                     margin: float) -> DataFrame:
    """Mean of 0.5 * (y d^2 + (1-y) max(0, margin - d)^2), d = 1 - cos."""
    v = _pair_vectors(pairs_inst, query_vectors, candidate_vectors, 2)
    d = F.lit(1.0) - cosine_rows(F.col("v0"), F.col("v1"))
    y = F.col("label").cast("double")
    row = F.lit(0.5) * (y * d * d + (F.lit(1.0) - y) * F.pow(F.greatest(F.lit(0.0), F.lit(float(margin)) - d), 2))
    return v.agg(F.count(F.lit(1)).alias("n"), F.avg(row).alias("loss"))


def cosine_mse_loss(pairs_inst: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame) -> DataFrame:
    """Mean of (cos - label)^2."""
    v = _pair_vectors(pairs_inst, query_vectors, candidate_vectors, 2)
    err = cosine_rows(F.col("v0"), F.col("v1")) - F.col("label").cast("double")
    return v.agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("loss"))


def triplet_loss(triplets: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame,
                 margin: float) -> DataFrame:
    """A10: mean of max(0, |a-p| - |a-n| + margin), Euclidean distances."""
    v = _pair_vectors(triplets, query_vectors, candidate_vectors, 3)
    row = F.greatest(F.lit(0.0), euclid_rows(F.col("v0"), F.col("v1")) - euclid_rows(F.col("v0"), F.col("v2"))
                     + F.lit(float(margin)))
    return v.agg(F.count(F.lit(1)).alias("n"), F.avg(row).alias("loss"))
