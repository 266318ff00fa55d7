"""Retrieval evaluation -- top-k search over the test set, then NDCG@k and
micro precision / recall / F1 in one job. S6: the result log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import gold_rows, micro_prf, ndcg_at_k, percent4, prediction_rows
from ..operators.similarity import top_k_join, with_vectors
from ..session import materialize


def test_query_vectors(testing: DataFrame, query_vectors: DataFrame, encoder=None) -> DataFrame:
    """A vector for every test query: the dictionary's, or by ``encoder`` for unseen texts. Without an encoder
    an unseen query is an error: it would count in recall and NDCG although it was never searched."""
    v = with_vectors(testing.select("query_id", "query"), "query", query_vectors, "embedding", encoder)
    v = materialize(v.select("query_id", "embedding"))
    lost = v.filter(F.col("embedding").isNull()).count()
    if lost:
        raise ValueError(f"{lost} test queries have no vector; pass an encoder or take them out of the test set")
    return v


def search_test_set(testing: DataFrame, query_vectors: DataFrame, candidates: DataFrame,
                    k: int = 5, threshold: float = 0.0, checkpoint: bool = True, encoder=None,
                    **kernel_opts) -> DataFrame:
    """Top-k hits of every test query (L2 of the survey). The hit table is
    checkpointed: both metrics read it, and the kernel runs once."""
    hits = top_k_join(test_query_vectors(testing, query_vectors, encoder), candidates, k=k,
                      threshold=threshold, **kernel_opts)
    return materialize(hits) if checkpoint else hits


def evaluate(testing: DataFrame, query_vectors: DataFrame, candidates: DataFrame,
             n_candidates: int, k: int = 5, threshold: float = 0.0,
             hits: DataFrame | None = None, **kernel_opts) -> DataFrame:
    """One row: ndcg, ndcg_x100 (as logged), precision, recall, f1, counts."""
    if hits is None:
        hits = search_test_set(testing, query_vectors, candidates, k, threshold, **kernel_opts)
    nd = ndcg_at_k(hits, testing, candidates, n_candidates, k)
    prf = micro_prf(prediction_rows(hits), gold_rows(testing))
    p = prf.select(F.struct(*prf.columns)).scalar()      # one-row result as a scalar subquery
    return nd.select("ndcg", percent4(F.col("ndcg")).alias("ndcg_x100"),
                     *[p[c].alias(c) for c in ("precision", "recall", "f1", "tp", "n_pred", "n_gold")])


def append_results(results: DataFrame, path: str, run_id: str, model: str, epoch: int) -> None:
    """Add the metrics of a run's epoch to a Parquet result log. Logging the same run and epoch again (a
    retried job) replaces its rows; the rest of the log stays."""
    (results.select(F.lit(run_id).alias("run_id"), F.lit(model).alias("model"),
                    F.lit(int(epoch)).alias("epoch"), "*")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "epoch").parquet(path))


def read_results(spark, path: str) -> DataFrame:
    """The result log; run ids are text, also those that look like numbers."""
    found = spark.read.parquet(path).schema
    kinds = {"run_id": T.StringType(), "epoch": T.IntegerType()}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])
    return spark.read.schema(schema).parquet(path)
