"""Ranking and set metrics.

All of them are distributed aggregations over long-form rows; no dense
n_queries x n_candidates matrix is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import exclusive_prefix_sum
from .similarity import first_position
from ..session import materialize

#: Distinct labels whose ranks are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


# -------------------------------------------------------------- set metrics
def prediction_rows(hits: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Predicted list -> set rows (distinct)."""
    return hits.select(key, F.col(text).alias("text")).distinct()


def gold_rows(testing: DataFrame, key: str = "query_id", labels: str = "labels") -> DataFrame:
    """Gold label list -> set rows (distinct)."""
    return testing.select(key, F.explode(labels).alias("text")).distinct()


def micro_prf(pred: DataFrame, gold: DataFrame, key: str = "query_id") -> DataFrame:
    """A1-A3 (+J6/U2): micro precision, recall and F1 over per-query sets.

    One full outer join of the distinct (query, text) rows of both sides and
    one aggregate: TP = rows on both sides. A zero denominator gives NULL."""
    p = pred.select(key, "text", F.lit(1).alias("_p"))
    g = gold.select(key, "text", F.lit(1).alias("_g"))
    j = p.join(g, [key, "text"], "full_outer")
    agg = j.agg(F.sum(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1).otherwise(0))
                .cast("long").alias("tp"),
                F.count("_p").cast("long").alias("n_pred"),
                F.count("_g").cast("long").alias("n_gold"))
    prec = F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("n_gold").cast("double"))
    return agg.select("tp", "n_pred", "n_gold", prec.alias("precision"), rec.alias("recall")) \
              .withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"),
                                             F.col("precision") + F.col("recall")))


# -------------------------------------------------------------- NDCG
def _disc_sum(lo: Column, hi: Column) -> Column:
    """sum_{p=lo..hi} 1/log2(p+1); 0 when hi < lo."""
    return F.when(hi >= lo, F.aggregate(
        F.sequence(lo, F.greatest(lo, hi)), F.lit(0.0),
        lambda acc, p: acc + F.lit(1.0) / F.log2(p.cast("double") + 1.0))).otherwise(F.lit(0.0))


def ndcg_per_query(hits: DataFrame, testing: DataFrame, dictionary: DataFrame,
                   n_candidates: int, k: int = 5, key: str = "query_id") -> DataFrame:
    """A4: NDCG@k per query with averaged ties, as defined in SURVEY 2.12.

    hits: ``key, rank, corpus_id, text, score``; testing: ``key, labels``; dictionary:
    ``corpus_id, text``. Every test query gets a row (no gold -> 0)."""
    firsts = first_position(dictionary).withColumnRenamed("corpus_id", "pos")
    # hits resolve to the first position of their text; a later hit overwrites
    if "corpus_id" in hits.columns:
        # by id, and only for entries that repeat an earlier one's text: a hub entry is no join key
        later = dictionary.join(firsts, "text").filter("corpus_id <> pos").select("corpus_id", "pos")
        hp = hits.join(later, "corpus_id", "left").withColumn("pos", F.coalesce("pos", "corpus_id"))
    else:
        hp = hits.join(firsts, "text")
    hp = hp.groupBy(key, "pos").agg(F.max_by("score", "rank").alias("score"))
    gold = gold_rows(testing, key).join(firsts, "text").select(key, "pos").distinct()  # J7
    hp = hp.join(gold.withColumn("rel", F.lit(1)), [key, "pos"], "left") \
           .withColumn("rel", F.coalesce("rel", F.lit(0)))
    groups = hp.groupBy(key, "score").agg(F.count(F.lit(1)).alias("c"), F.sum("rel").alias("r"))
    w = Window.partitionBy(key).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("a", F.coalesce(F.sum("c").over(w), F.lit(0)) + 1) \
                   .withColumn("b", F.col("a") + F.col("c") - 1)
    kk = F.lit(k).cast("long")
    per_q = groups.groupBy(key).agg(
        F.sum(F.col("r") / F.col("c") * _disc_sum(F.col("a"), F.least(F.col("b"), kk))).alias("dcg_hits"),
        F.sum("c").alias("h"), F.sum("r").alias("tp"))
    g_cnt = gold.groupBy(key).agg(F.count(F.lit(1)).alias("g"))
    m = F.lit(int(n_candidates)).cast("long")
    q = (testing.select(key).distinct()
         .join(per_q, key, "left").join(g_cnt, key, "left")
         .select(key, F.coalesce("dcg_hits", F.lit(0.0)).alias("dcg_hits"),
                 F.coalesce("h", F.lit(0)).cast("long").alias("h"),
                 F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
                 F.coalesce("g", F.lit(0)).cast("long").alias("g")))
    rest_share = F.when(m > F.col("h"), (F.col("g") - F.col("tp")).cast("double")
                        / (m - F.col("h")).cast("double")).otherwise(F.lit(0.0))
    dcg = F.col("dcg_hits") + rest_share * _disc_sum(F.col("h") + 1, F.least(kk, m))
    idcg = _disc_sum(F.lit(1).cast("long"), F.least(kk, F.col("g")))
    return q.select(key, F.when(idcg > 0, dcg / idcg).otherwise(F.lit(0.0)).alias("ndcg"))


def ndcg_at_k(hits, testing, dictionary, n_candidates: int, k: int = 5,
              key: str = "query_id") -> DataFrame:
    """A4: mean NDCG@k over all test queries (one row)."""
    return ndcg_per_query(hits, testing, dictionary, n_candidates, k, key) \
        .agg(F.avg("ndcg").alias("ndcg"))


def percent4(c: Column) -> Column:
    """``round(x, 4) * 100`` as logged by the reference."""
    return F.round(c, 4) * F.lit(100.0)


# -------------------------------------------------------------- correlation
def similarity_correlation(scored: DataFrame, sim: str = "score", label: str = "label") -> DataFrame:
    """Pearson and Spearman correlation of similarity vs label.

    Spearman is Pearson of mid-ranks; the mid-rank of a value is
    rank() + (ties - 1) / 2, from a distributed prefix sum over per-value
    counts (no single-partition sort)."""
    base = scored.select(F.col(sim).cast("double").alias("x"), F.col(label).cast("double").alias("y")) \
                 .filter(~F.isnan("x") & F.col("x").isNotNull() & F.col("y").isNotNull())
    # equal pairs are counted first, so a label shared by half of all rows is one row per score
    cells = materialize(base.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
    ranked = cells.join(_mid_ranks(cells, "x"), "x")
    ry = materialize(_mid_ranks(cells, "y"))
    ranked = ranked.join(F.broadcast(ry) if ry.count() <= BROADCAST_LABELS else ry, "y")
    return ranked.agg(_weighted_corr("x", "y").alias("pearson"),
                      _weighted_corr("x_rank", "y_rank").alias("spearman"))


def _weighted_corr(a: str, b: str) -> Column:
    """Pearson correlation of ``a`` and ``b``, each row counted ``n`` times; null without variance."""
    n, x, y = F.col("n"), F.col(a), F.col(b)
    total, sx, sy = F.sum(n), F.sum(n * x), F.sum(n * y)
    cov = F.sum(n * x * y) - sx * sy / total
    vx, vy = F.sum(n * x * x) - sx * sx / total, F.sum(n * y * y) - sy * sy / total
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def _mid_ranks(df: DataFrame, col: str) -> DataFrame:
    """distinct value -> mid-rank = (#smaller values) + (ties + 1) / 2, with a
    distributed prefix sum over the per-value counts."""
    counts = df.groupBy(col).agg(F.sum("n").alias("_n"))
    below = exclusive_prefix_sum(counts, col, "_n", "_below")
    return below.select(col, (F.col("_below") + (F.col("_n") + 1.0) / 2.0).alias(f"{col}_rank"))
