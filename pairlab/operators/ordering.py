"""Distributed global ordering helpers (reader positions, fill draws, A11 mid-ranks).

A global ``row_number()`` without a partition key runs in one task; here the
rows are range-partitioned on a unique sort key, each row's partition and
place there come from ``monotonically_increasing_id``, and per-partition
counts -- one row per partition, so bounded by the partition count, not the
data -- give the offsets, joined back by broadcast.

The numbered frame is checkpointed into the session's checkpoint folder so
that the partition assignment is frozen: a lost executor re-reads it instead
of recomputing a different split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def with_global_index(df: DataFrame, order_cols: list[str], out: str = "idx",
                      partitions: int | None = None) -> DataFrame:
    """Add a 0-based global position by ``order_cols`` (rows equal in them are numbered in any order)."""
    spark = df.sparkSession
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols)
    ensure_checkpoint_dir(spark)
    numbered = ordered.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    numbered = numbered.withColumn("_pid", F.shiftright("_mid", 33))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + local).cast("long")).drop("_pid", "_mid", "_off"))


def exclusive_prefix_sum(df: DataFrame, order_col: str, value_col: str, out: str,
                         partitions: int | None = None) -> DataFrame:
    """sum of ``value_col`` over rows with a smaller ``order_col`` (unique),
    computed per range partition plus per-partition offsets."""
    spark = df.sparkSession
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, order_col).sortWithinPartitions(order_col)
    schema = T.StructType(ordered.schema.fields + [
        T.StructField("_pid", T.IntegerType(), False), T.StructField("_cum", T.DoubleType(), False)])

    def local(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx is not None else 0
        run = 0.0
        for pdf in batches:
            vals = pdf[value_col].astype("float64").to_numpy()
            cum = run + np.concatenate([[0.0], np.cumsum(vals)[:-1]]) if len(vals) else vals
            run += float(vals.sum())
            pdf = pdf.copy()
            pdf["_pid"] = np.int32(pid)
            pdf["_cum"] = cum
            yield pdf

    numbered = ordered.mapInPandas(local, schema)
    ensure_checkpoint_dir(spark)
    numbered = numbered.checkpoint(eager=True)
    totals = numbered.groupBy("_pid").agg(F.sum(value_col).cast("double").alias("_tot"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(w), F.lit(0.0)).alias("_off"))
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_cum")).drop("_pid", "_cum", "_off"))

