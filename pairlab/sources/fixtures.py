"""Fixtures derived from the driver tables (FIXTURES.md section B).

V1 turns ``embeddings`` into a candidate dictionary, a query dictionary,
training / validation pairs and a multi-label test set, with the geometry
of a real retrieval problem (each query sits between two candidates).
Everything is column arithmetic plus two equi-joins, so it scales with the
``embeddings`` table. The same derivation is also written as DuckDB SQL
(``v1_sql_ctes``) for the correctness oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize, weighted_sum

# Fixed values of the V1 recipe (FIXTURES.md, V1).
GROUP = 5            # every 5th embedding row is a candidate
C2_MUL, C2_R, C2_ADD = 7, 3, 1
W1_BASE, W1_STEP = 0.5, 0.1     # weight of candidate c1: 0.5 + 0.1 r
W2_BASE, W2_STEP = 0.9, 0.1     # weight of candidate c2: 0.9 - 0.1 r
W_OWN = 0.35
OOV_MOD, OOV_REM = 50, 1
OOV_LABEL = "oov"


@dataclass
class VectorFixture:
    candidates: DataFrame   # corpus_id, text, embedding
    queries: DataFrame      # corpus_id, text, embedding, vec_id
    training: DataFrame     # row_id, text1, text2, label
    validation: DataFrame   # row_id, text1, text2, label
    testing: DataFrame      # query_id, query, labels
    n_candidates: int


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small Parquet file is one partition; hash-spread it over the default
    parallelism so per-row vector work runs on every core. Large inputs
    already have enough partitions and are left alone."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < parts:
        return df.repartition(parts, key)
    return df


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_fixture(spark: SparkSession, sf_dir: str) -> VectorFixture:
    emb = spread(_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id")
    n_rows = emb.count()
    m = n_rows // GROUP

    cand = emb.filter(F.col("vec_id") % GROUP == 0).select(
        (F.col("vec_id") / GROUP).cast("long").alias("corpus_id"),
        F.col("v").alias("embedding"))
    cand = cand.withColumn("text", F.concat(F.lit("cand_"), F.col("corpus_id").cast("string"))) \
               .select("corpus_id", "text", "embedding")

    r = F.col("vec_id") % GROUP
    c1 = F.floor(F.col("vec_id") / GROUP).cast("long")
    c2a = (F.lit(C2_MUL) * c1 + F.lit(C2_R) * r + F.lit(C2_ADD)) % F.lit(m)
    q = (emb.filter(r != 0)
         .select("vec_id", r.alias("r"), c1.alias("c1"), c2a.alias("c2a"), "v")
         .withColumn("c2", F.when(F.col("c2a") == F.col("c1"), (F.col("c2a") + 1) % F.lit(m))
                     .otherwise(F.col("c2a")))
         .drop("c2a"))
    a = cand.select(F.col("corpus_id").alias("c1"), F.col("embedding").alias("v1"))
    b = cand.select(F.col("corpus_id").alias("c2"), F.col("embedding").alias("v2"))
    rr = F.col("r").cast("double")
    w1 = F.lit(W1_BASE) + F.lit(W1_STEP) * rr
    w2 = F.lit(W2_BASE) - F.lit(W2_STEP) * rr
    mixed = weighted_sum([(w1, F.col("v1")), (w2, F.col("v2")), (F.lit(W_OWN), F.col("v"))])
    # query position = rank of vec_id among rows with r != 0 (dense, no window)
    qpos = F.col("vec_id") - F.floor(F.col("vec_id") / GROUP) - 1
    qv = (q.join(a, "c1").join(b, "c2")
          .select(qpos.cast("long").alias("corpus_id"), "vec_id", "r", "c1", "c2",
                  F.concat(F.lit("q_"), F.col("vec_id").cast("string")).alias("text"),
                  normalize(mixed).alias("embedding")))

    queries = qv.select("corpus_id", "text", "embedding", "vec_id")
    ctext1 = F.concat(F.lit("cand_"), F.col("c1").cast("string"))
    ctext2 = F.concat(F.lit("cand_"), F.col("c2").cast("string"))
    training = qv.select(F.col("corpus_id").alias("row_id"), F.col("text").alias("text1"),
                         ctext1.alias("text2"), F.lit(1.0).alias("label"))
    validation = qv.select(F.explode(F.array(
        F.struct((F.col("corpus_id") * 2).alias("row_id"), F.col("text").alias("text1"),
                 ctext1.alias("text2"), F.lit(1.0).alias("label")),
        F.struct((F.col("corpus_id") * 2 + 1).alias("row_id"), F.col("text").alias("text1"),
                 ctext2.alias("text2"), F.lit(0.0).alias("label")))).alias("p")).select("p.*")
    labels = F.concat(
        F.array(ctext1),
        F.when(F.col("r").isin(1, 2), F.array(ctext2)).otherwise(F.array().cast("array<string>")),
        F.when(F.col("vec_id") % OOV_MOD == OOV_REM, F.array(F.lit(OOV_LABEL)))
         .otherwise(F.array().cast("array<string>")))
    testing = qv.select(F.col("corpus_id").alias("query_id"), F.col("text").alias("query"),
                        labels.alias("labels"))
    return VectorFixture(cand, queries, training, validation, testing, m)


def v1_sql_ctes() -> str:
    """DuckDB CTEs building the same V1 tables: v1_cand, v1_query,
    v1_training, v1_validation, v1_testing (vectors as DOUBLE[])."""
    return f"""
v1_emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
v1_meta AS (SELECT COUNT(*) // {GROUP} AS m FROM v1_emb),
v1_cand AS (SELECT vec_id // {GROUP} AS corpus_id, 'cand_' || CAST(vec_id // {GROUP} AS VARCHAR) AS text,
                   v AS embedding FROM v1_emb WHERE vec_id % {GROUP} = 0),
v1_q0 AS (SELECT e.vec_id, e.vec_id % {GROUP} AS r, e.vec_id // {GROUP} AS c1,
                 ({C2_MUL} * (e.vec_id // {GROUP}) + {C2_R} * (e.vec_id % {GROUP}) + {C2_ADD}) % meta.m AS c2a,
                 meta.m AS m, e.v
          FROM v1_emb e, v1_meta meta WHERE e.vec_id % {GROUP} <> 0),
v1_q1 AS (SELECT vec_id, r, c1, CASE WHEN c2a = c1 THEN (c2a + 1) % m ELSE c2a END AS c2, v FROM v1_q0),
v1_q2 AS (SELECT q.vec_id, q.r, q.c1, q.c2,
                 list_transform(list_zip(a.embedding, b.embedding, q.v),
                     lambda x: ({W1_BASE}::DOUBLE + {W1_STEP}::DOUBLE * CAST(q.r AS DOUBLE)) * x[1]
                        + ({W2_BASE}::DOUBLE - {W2_STEP}::DOUBLE * CAST(q.r AS DOUBLE)) * x[2]
                        + {W_OWN}::DOUBLE * x[3]) AS mv
          FROM v1_q1 q JOIN v1_cand a ON a.corpus_id = q.c1 JOIN v1_cand b ON b.corpus_id = q.c2),
v1_q3 AS (SELECT *, sqrt(list_sum(list_transform(mv, lambda x: x * x))) AS nrm FROM v1_q2),
v1_query AS (SELECT vec_id - vec_id // {GROUP} - 1 AS corpus_id, vec_id, r, c1, c2,
                    'q_' || CAST(vec_id AS VARCHAR) AS text,
                    CASE WHEN nrm > 0 THEN list_transform(mv, lambda x: x / nrm) ELSE mv END AS embedding
             FROM v1_q3),
v1_training AS (SELECT corpus_id AS row_id, text AS text1, 'cand_' || CAST(c1 AS VARCHAR) AS text2,
                       1.0::DOUBLE AS label FROM v1_query),
v1_validation AS (SELECT corpus_id * 2 AS row_id, text AS text1, 'cand_' || CAST(c1 AS VARCHAR) AS text2,
                         1.0::DOUBLE AS label FROM v1_query
                  UNION ALL
                  SELECT corpus_id * 2 + 1, text, 'cand_' || CAST(c2 AS VARCHAR), 0.0::DOUBLE FROM v1_query),
v1_testing AS (SELECT corpus_id AS query_id, text AS query,
                      list_concat(['cand_' || CAST(c1 AS VARCHAR)],
                                  CASE WHEN r IN (1, 2) THEN ['cand_' || CAST(c2 AS VARCHAR)] ELSE [] END,
                                  CASE WHEN vec_id % {OOV_MOD} = {OOV_REM} THEN ['{OOV_LABEL}'] ELSE [] END) AS labels
               FROM v1_query)"""


@dataclass
class TextFixture:
    candidates: DataFrame   # corpus_id (item_id), text
    queries: DataFrame      # doc_id, text


def text_fixture(spark: SparkSession, sf_dir: str) -> TextFixture:
    """V2: benchmark items as the candidate dictionary, whole documents as queries."""
    items = spread(_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("corpus_id"), "text"), "corpus_id")
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return TextFixture(items, docs)
