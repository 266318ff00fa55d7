"""Structured Streaming.

T1 -- online search: a file-source stream of queries is matched against the
static candidate dictionary in ``foreachBatch`` with the same block kernel
as the batch join. Each micro-batch overwrites its own ``batch=<id>``
folder, so a replayed batch (after a failure) rewrites the same rows:
the sink is idempotent and the stream's checkpoint gives exactly-once
output. No state, no watermark.

T2 -- rolling retrieval quality: every micro-batch of labelled test queries
appends the counts of each of its rows (true positives, predicted, gold; plus
event time when present) to a Parquet table. Rows are counted one by one, not
merged by key, so results do not depend on how rows fall into micro-batches;
rows of a micro-batch that ask the same (equal vector and labels) are scored
once, and each of them gets those counts;
with event time and a watermark, rows delivered more than once (equal key,
time and labels) are counted once by stateful deduplication; micro precision / recall / F1 are an
aggregation on read, over all batches or per tumbling event-time window.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import BROADCAST_LABELS, gold_rows, prediction_rows
from ..operators.similarity import top_k_join
from ..operators.blocks import packed_targets
from ..session import ensure_checkpoint_dir, materialize


def stream_root(spark: SparkSession, name: str) -> str:
    """Folder under the shared checkpoint directory for a stream's files."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", name)


def search_stream(spark: SparkSession, source_dir: str, schema, candidates: DataFrame,
                  sink_dir: str, checkpoint_dir: str, *, key: str, encode=None, k: int = 5,
                  threshold: float = 0.0, max_files_per_trigger: int = 1, **kernel_opts):
    """Start the stream and return the StreamingQuery (trigger: available now).

    ``encode(df) -> df`` adds an ``embedding`` column to a micro-batch (e.g.
    ``encode_distinct``); when None the source already carries one."""
    # the dictionary is static: pack it once for every micro-batch
    packed = packed_targets(materialize(candidates.select("corpus_id", "text", "embedding")))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        q = encode(batch) if encode else batch
        hits = top_k_join(q.select(key, "embedding"), packed, k=k, threshold=threshold, key=key, **kernel_opts)
        (hits.withColumn("batch", F.lit(int(batch_id)))
         .write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch={int(batch_id)}")))

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    return (stream.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def quality_stream(spark: SparkSession, source_dir: str, schema, candidates: DataFrame,
                   sink_dir: str, checkpoint_dir: str, *, key: str = "query_id", k: int = 5,
                   ts_col: str | None = None, watermark: str | None = None, max_files_per_trigger: int = 1,
                   **kernel_opts):
    """The counts of each row, written idempotently by micro-batch. With ``ts_col`` and ``watermark``, rows
    with equal key, event time and labels that come within the watermark are counted once."""
    packed = packed_targets(materialize(candidates.select("corpus_id", "text", "embedding")))

    same = ["embedding", "labels"]
    once = bool(ts_col and watermark)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # a batch of the files alone may be read twice, one that went through the state is written first
        rows = (materialize(batch) if once else batch).withColumn(
            "_ask", F.xxhash64(F.size("embedding"), "embedding", F.size("labels"), "labels"))
        # a number for each distinct question, fixed by writing them
        asked = materialize(rows.select("_ask", *same).distinct().withColumn("_row", F.monotonically_increasing_id()))
        hits = top_k_join(asked.select("_row", "embedding"), packed, k=k, key="_row", **kernel_opts)
        p = prediction_rows(hits, "_row").withColumn("_p", F.lit(1))
        g = gold_rows(asked, "_row").withColumn("_g", F.lit(1))
        counts = p.join(g, ["_row", "text"], "full_outer").groupBy("_row").agg(
            F.sum(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1).otherwise(0)).alias("tp"),
            F.count("_p").alias("n_pred"), F.count("_g").alias("n_gold"))
        found = asked.join(counts, "_row").drop("_row")
        kept = rows.select("_ask", *same, key, *([ts_col] if ts_col else [])).alias("r")
        n = asked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_ask").alias("d")).first()
        on = F.col("r._ask") == F.col("f._ask")
        if n["n"] == n["d"]:
            found = found.drop(*same)      # each question has a hash of its own
            found = F.broadcast(found) if n["n"] <= BROADCAST_LABELS else found
        else:
            on &= F.col("r.embedding").eqNullSafe(F.col("f.embedding")) & F.col("r.labels").eqNullSafe(F.col("f.labels"))
        (kept.join(found.alias("f"), on).select(f"r.{key}", *([f"r.{ts_col}"] if ts_col else []), "tp", "n_pred", "n_gold")
         .withColumn("batch", F.lit(int(batch_id)))
         .write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch={int(batch_id)}")))

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    if ts_col and watermark:
        stream = stream.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([key, ts_col, "labels"])
    return (stream.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def rolling_quality(spark: SparkSession, sink_dir: str, window: str | None = None,
                    ts_col: str = "ts") -> DataFrame:
    """T2 read side: micro P/R/F1 over everything, or per tumbling window."""
    counts = spark.read.parquet(sink_dir)
    keys = [F.window(ts_col, window).alias("window")] if window else []
    agg = counts.groupBy(*keys).agg(F.sum("tp").cast("long").alias("tp"),
                                    F.sum("n_pred").cast("long").alias("n_pred"),
                                    F.sum("n_gold").cast("long").alias("n_gold"))
    prec = F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("n_gold").cast("double"))
    return agg.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def windowed_quality_stream(spark: SparkSession, counts_dir: str, counts_schema, sink_dir: str,
                            checkpoint_dir: str, *, window: str = "1 day", watermark: str = "1 day",
                            ts_col: str = "ts", max_files_per_trigger: int = 1):
    """T2, event-time form: a second stream reads the per-query count files
    and sums them per tumbling ``window`` of event time with a watermark
    (late rows beyond it are dropped and window state is released). Update
    mode: each micro-batch writes the windows it changed to its own folder;
    ``windowed_quality`` keeps each window's latest value."""
    src = (spark.readStream.schema(counts_schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(counts_dir))
    agg = (src.withWatermark(ts_col, watermark)
           .groupBy(F.window(ts_col, window).alias("w"))
           .agg(F.sum("tp").cast("long").alias("tp"), F.sum("n_pred").cast("long").alias("n_pred"),
                F.sum("n_gold").cast("long").alias("n_gold")))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "tp", "n_pred", "n_gold", F.lit(int(batch_id)).alias("batch"))
         .write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch={int(batch_id)}")))

    return (agg.writeStream.outputMode("update").foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def windowed_quality(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Latest value of every window plus its micro P/R/F1."""
    rows = spark.read.parquet(sink_dir)
    last = rows.groupBy("window_start", "window_end").agg(
        F.max_by(F.struct("tp", "n_pred", "n_gold"), F.col("batch")).alias("v"))
    out = last.select("window_start", "window_end", "v.tp", "v.n_pred", "v.n_gold")
    prec = F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("n_gold").cast("double"))
    return out.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def run_to_completion(query) -> None:
    """Wait, as long as it takes, for an available-now stream; raise its error if it failed."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
