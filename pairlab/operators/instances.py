"""Training-instance assembly (I1-I6, U1, C3, C4, P10) and batching.

An instance is ``instance_id, row_id, texts array<string>, label double``.
Rows whose mining came back short are handled by ``on_short``:
``drop`` (default; returned separately), ``keep`` (shorter arrays), ``fill``
(I3-I5: a uniform negative in the place of the missing hard one) or
``error``. In I3 and I4 the labelled pair itself stays in any case; only its
missing negative is left out.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashrand as hr
from ..session import materialize
from .mining import (MULTI_EFN, TOPK, MiningResult, easy_negatives, materialize_dictionary, mine_negatives,
                     negatives_as_arrays)

KINDS = ("bidirectional", "one_way", "contrastive", "sentence", "triplet", "validation")


def _empty():
    return F.array().cast("array<string>")


@dataclass
class InstanceResult:
    instances: DataFrame   # instance_id, row_id, texts, label
    dropped: DataFrame     # row_id, reason


def _apply_short(inst: DataFrame, short: DataFrame, on_short: str) -> InstanceResult:
    short = short.select("row_id", "reason").dropDuplicates(["row_id"])
    if on_short == "keep":
        return InstanceResult(inst, short.limit(0))
    if on_short == "error":
        if not short.isEmpty():
            raise ValueError("some rows have fewer negatives than requested")
        return InstanceResult(inst, short)
    if on_short != "drop":
        raise ValueError("on_short must be 'drop', 'keep' or 'error' ('fill' too for one negative a row)")
    return InstanceResult(inst.join(short.select("row_id"), "row_id", "left_anti"), short)


def build_instances(kind: str, pairs: DataFrame, query_vectors: DataFrame,
                    candidate_vectors: DataFrame, *, method: str = "multinomial",
                    num_hard_negative_queries: int = 10, num_hard_negative_candidates: int = 3,
                    positive_threshold: float = 0.5, beta: float = 1.0, seed: int = 0, epoch: int = 0,
                    use_hard_negative: bool = True, on_short: str = "drop", encoder=None,
                    mined: tuple[MiningResult, MiningResult] | None = None, **kernel_opts) -> InstanceResult:
    """I1-I6. ``pairs``: ``row_id, text1, text2, label``. ``mined`` (bidirectional): hard queries and hard candidates
    that were mined before."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    lab = F.col("label").cast("double").alias("label")
    if kind != "validation":
        pairs = materialize(pairs)
        query_vectors = materialize_dictionary(query_vectors)
        candidate_vectors = materialize_dictionary(candidate_vectors)
    common = dict(positive_threshold=positive_threshold, beta=beta, seed=seed, epoch=epoch, encoder=encoder,
                  **kernel_opts)

    if kind == "validation":                                           # I6
        inst = pairs.select(F.col("row_id").alias("instance_id"), "row_id",
                            F.array("text1", "text2").alias("texts"), lab)
        return InstanceResult(inst, pairs.select("row_id", F.lit("").alias("reason")).limit(0))

    if kind == "bidirectional":                                        # I1
        if mined is None:
            # the two directions are independent jobs: run them side by side
            with ThreadPoolExecutor(max_workers=2) as pool:
                fq = pool.submit(mine_negatives, pairs, query_vectors, candidate_vectors, anchor="candidate",
                                 method=method, num_negatives=num_hard_negative_queries, **common)
                fc = pool.submit(mine_negatives, pairs, query_vectors, candidate_vectors, anchor="query",
                                 method=method, num_negatives=num_hard_negative_candidates, **common)
                mined = fq.result(), fc.result()
        hq, hc = mined
        # both directions gathered by one groupBy (side 0 = hard queries, 1 = hard candidates)
        both = (hq.negatives.select("row_id", F.lit(0).alias("side"), "slot", "text")
                .unionByName(hc.negatives.select("row_id", F.lit(1).alias("side"), "slot", "text")))
        arr = both.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("side", "slot", "text"))).alias("_n"))
        arr = arr.select("row_id",
                         F.transform(F.filter("_n", lambda e: e["side"] == 0), lambda e: e["text"]).alias("hq"),
                         F.transform(F.filter("_n", lambda e: e["side"] == 1), lambda e: e["text"]).alias("hc"))
        inst = (pairs.join(arr, "row_id", "left")
                .select(F.col("row_id").alias("instance_id"), "row_id",
                        F.concat(F.array("text1"), F.coalesce("hq", _empty()), F.array("text2"),
                                 F.coalesce("hc", _empty())).alias("texts"), lab))
        return _apply_short(inst, hq.short.unionByName(hc.short), on_short)

    if kind == "one_way":                                              # I2
        n = num_hard_negative_candidates
        if n == 0:
            inst = pairs.select(F.col("row_id").alias("instance_id"), "row_id",
                                F.array("text1", "text2").alias("texts"), lab)
            return InstanceResult(inst, pairs.select("row_id", F.lit("").alias("reason")).limit(0))
        hc = mine_negatives(pairs, query_vectors, candidate_vectors, anchor="query",
                            method=MULTI_EFN, num_negatives=n, **common)
        ca = negatives_as_arrays(hc.negatives).withColumnRenamed("negatives", "hc")
        inst = pairs.join(ca, "row_id", "left").select(
            F.col("row_id").alias("instance_id"), "row_id",
            F.concat(F.array("text1", "text2"), F.coalesce("hc", _empty())).alias("texts"), lab)
        return _apply_short(inst, hc.short, on_short)

    # One negative candidate per row (hard: topK n=1, or easy: uniform)
    if use_hard_negative:
        res = mine_negatives(pairs, query_vectors, candidate_vectors, anchor="query",
                             method=method if method != "multinomial" else TOPK, num_negatives=1, **common)
        neg = res.negatives.filter(F.col("slot") == 1).select("row_id", F.col("text").alias("neg"))
        short = res.short
    else:
        neg = easy_negatives(pairs, candidate_vectors, seed=seed, epoch=epoch) \
            .select("row_id", F.col("text").alias("neg"))
        short = pairs.join(neg, "row_id", "left_anti").select("row_id", F.lit("empty_pool").alias("reason"))
    if on_short == "fill":
        lost = pairs.join(neg, "row_id", "left_anti")
        spare = easy_negatives(lost, candidate_vectors, seed=seed, epoch=epoch, stream=hr.STREAM_SHORT)
        neg = materialize(neg.unionByName(spare.select("row_id", F.col("text").alias("neg"))))
        short = pairs.join(neg, "row_id", "left_anti").select("row_id", F.lit("empty_pool").alias("reason"))
        on_short = "drop"      # what is left has no other candidate at all
    joined = pairs.join(neg, "row_id", "left")
    if kind == "triplet":                                              # I5
        inst = joined.select(F.col("row_id").alias("instance_id"), "row_id",
                             F.array("text1", "text2", "neg").alias("texts"), lab)
        inst = inst.filter(F.col("texts")[2].isNotNull()) if on_short != "keep" else inst
        return _apply_short(inst, short, on_short)
    # Positive pairs keep their label, negatives get 0.0
    pos = pairs.select((F.col("row_id") * 2).alias("instance_id"), "row_id",
                       F.array("text1", "text2").alias("texts"), lab)
    negs = joined.filter(F.col("neg").isNotNull()).select(
        (F.col("row_id") * 2 + 1).alias("instance_id"), "row_id",
        F.array("text1", "neg").alias("texts"), F.lit(0.0).alias("label"))
    res = _apply_short(negs, short, on_short)
    return InstanceResult(pos.unionByName(res.instances), res.dropped)


def assign_batches(instances: DataFrame, batch_size: int = 32, seed: int = 0, epoch: int = 0,
                   id_col: str = "instance_id", buckets: int | None = None) -> DataFrame:
    """Shuffle by a keyed hash and cut consecutive groups of ``batch_size``
    (the last batch may be short). Adds ``batch_id long, pos int``.

    The order (hash, id) is global but never sorted in one task: the hash's
    leading word is uniform on [0, P), so ``floor(word * B / P)`` splits it into
    B ordered, evenly filled buckets without sampling. Rows are numbered inside their
    bucket by a window, and per-bucket counts (B rows) give the offsets."""
    spark = instances.sparkSession
    nb = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                        spark.sparkContext.defaultParallelism)
    keyed = (instances.withColumn("_bk", hr.wide_expr(seed, epoch, hr.STREAM_BATCH, id_col))
             .withColumn("_b", F.floor(F.shiftright("_bk", 31) * F.lit(float(nb)) / F.lit(float(hr.P))).cast("int")))
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_bk", id_col)) - 1
    numbered = keyed.withColumn("_local", local)
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select("_b", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    idx = F.col("_off") + F.col("_local")
    b = F.lit(int(batch_size)).cast("long")
    return (numbered.join(F.broadcast(offsets), "_b")
            .withColumn("batch_id", F.floor(idx / b).cast("long"))
            .withColumn("pos", (idx % b).cast("int"))
            .drop("_bk", "_b", "_local", "_off"))
