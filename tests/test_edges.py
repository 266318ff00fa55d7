"""Hand-made edge rows (FIXTURES V5)."""

import pytest
from pyspark.sql import functions as F

from pairlab.operators import mining as mn
from pairlab.operators.metrics import ndcg_per_query
from pairlab.operators.similarity import top_k_join

DICT = "corpus_id long, text string, embedding array<double>"


def test_duplicate_texts_are_all_excluded_and_first_position_wins(spark):
    # candidates 0 and 2 share the text 'dup'; the row's true text is 'dup'
    cands = spark.createDataFrame([(0, "dup", [1.0, 0.0]), (1, "b", [0.9, 0.1]), (2, "dup", [0.99, 0.01]),
                                   (3, "c", [0.0, 1.0])], DICT)
    qs = spark.createDataFrame([(0, "q", [1.0, 0.02])], DICT)
    pairs = spark.createDataFrame([(0, "q", "dup", 1.0)], "row_id long, text1 string, text2 string, label double")
    r = mn.mine_negatives(pairs, qs, cands, anchor="query", method=mn.TOPK, positive_threshold=0.0,
                          num_negatives=3)
    texts = [x.text for x in r.negatives.orderBy("slot").collect()]
    assert "dup" not in texts and texts == ["b", "c"]
    # NDCG: a gold label 'dup' resolves to the first position (0) only
    hits = top_k_join(qs.select(F.col("corpus_id").alias("query_id"), "embedding"), cands, k=2)
    assert [h.corpus_id for h in hits.orderBy("rank").collect()] == [2, 0]   # cand 2 is closer
    tests = spark.createDataFrame([(0, ["dup"])], "query_id long, labels array<string>")
    v = ndcg_per_query(hits, tests, cands, 4, 5).collect()[0].ndcg
    assert 0.99 < v <= 1.0   # both hits resolve to position 0; the later hit overwrites the score


def test_zero_vector_scores_zero_and_is_not_a_hit(spark):
    cands = spark.createDataFrame([(0, "z", [0.0, 0.0]), (1, "a", [1.0, 0.0])], DICT)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    hits = top_k_join(q, cands, k=5).collect()
    assert [h.corpus_id for h in hits] == [1]          # score 0 is not > threshold 0


def test_only_unknown_labels_and_no_hits(spark):
    cands = spark.createDataFrame([(i, f"c{i}", [1.0, float(i)]) for i in range(10)], DICT)
    hits = spark.createDataFrame([], "query_id long, rank int, text string, score double")
    tests = spark.createDataFrame([(0, ["oov"]), (1, ["c3"])], "query_id long, labels array<string>")
    got = {r.query_id: r.ndcg for r in ndcg_per_query(hits, tests, cands, 10, 5).collect()}
    assert got[0] == 0.0
    assert got[1] == pytest.approx(0.29484591188793924)


def test_one_candidate_dictionary_pool_empty_after_exclusion(spark):
    cands = spark.createDataFrame([(0, "only", [1.0, 0.0])], DICT)
    qs = spark.createDataFrame([(0, "q", [1.0, 0.0])], DICT)
    pairs = spark.createDataFrame([(0, "q", "only", 1.0)], "row_id long, text1 string, text2 string, label double")
    r = mn.mine_negatives(pairs, qs, cands, anchor="query", method=mn.MULTI, positive_threshold=0.0,
                          num_negatives=2)
    assert r.negatives.count() == 0
    assert [(x.row_id, x.reason) for x in r.short.collect()] == [(0, "empty_pool")]


def test_eligible_exactly_n_gets_one_fill_that_can_displace(spark):
    # three candidates all eligible (L = n = 2 after exclusion of 'true'): faithful rule adds n+1-L = 1 draw
    cands = spark.createDataFrame([(0, "true", [1.0, 0.0]), (1, "a", [0.8, 0.6]), (2, "b", [0.6, 0.8])], DICT)
    qs = spark.createDataFrame([(0, "q", [1.0, 0.0])], DICT)
    pairs = spark.range(50).select(F.col("id").alias("row_id"), F.lit("q").alias("text1"),
                                   F.lit("true").alias("text2"), F.lit(1.0).alias("label"))
    r = mn.mine_negatives(pairs, qs, cands, anchor="query", method=mn.TOPK_EFN, positive_threshold=0.5,
                          beta=1.0, num_negatives=2, seed=4)
    neg = r.negatives.toPandas()
    assert len(neg) == 100                                  # n = 2 per row
    assert neg.is_fill.sum() <= 50                          # at most the one fill per row survives
    # a fill repeats an eligible target (pool = {a, b}); ties keep the eligible copy first
    for _, g in neg.groupby("row_id"):
        assert list(g.sort_values("slot").text)[0] == "a"
    exact = mn.mine_negatives(pairs, qs, cands, anchor="query", method=mn.TOPK_EFN, positive_threshold=0.5,
                              beta=1.0, num_negatives=2, seed=4, fill="exact")
    assert exact.negatives.filter("is_fill").count() == 0   # n - L = 0 draws


def test_score_above_one_by_rounding_is_clamped(spark):
    v = [0.6, 0.8]
    cands = spark.createDataFrame([(0, "same", v), (1, "x", [0.8, 0.6])], DICT)
    qs = spark.createDataFrame([(0, "q", v)], DICT)
    pairs = spark.createDataFrame([(0, "q", "x", 1.0)], "row_id long, text1 string, text2 string, label double")
    r = mn.mine_negatives(pairs, qs, cands, anchor="query", method=mn.TOPK, positive_threshold=0.5,
                          num_negatives=1).negatives.collect()
    assert r[0].text == "same" and r[0].score <= 1.0


def test_hit_projection_with_and_without_scores(spark):
    from pairlab.operators.similarity import nest_hits
    cands = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.6, 0.8]), (2, "c", [0.0, 1.0])], DICT)
    q = spark.createDataFrame([(5, [1.0, 0.1])], "query_id long, embedding array<double>")
    plain = top_k_join(q, cands, k=2, return_scores=False)
    assert plain.columns == ["query_id", "rank", "corpus_id", "text"]
    nested = nest_hits(top_k_join(q, cands, k=2)).collect()[0]
    assert [h.text for h in nested.hits] == ["a", "b"]
    assert nested.hits[0].score > nested.hits[1].score > 0
