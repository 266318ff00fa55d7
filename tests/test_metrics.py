import math

import pytest

from pairlab.operators.metrics import gold_rows, micro_prf, ndcg_per_query, percent4, prediction_rows

def plain_ndcg(hits, gold, m, k=5):
    """Plain-Python NDCG@k for one query (same definition).

    hits: list of (position, score) with distinct positions; gold: set of positions."""
    scores = [0.0] * m
    for pos, s in hits:
        scores[pos] = s
    rel = [1 if i in gold else 0 for i in range(m)]
    order = sorted(range(m), key=lambda i: -scores[i])
    disc = [1 / math.log2(p + 1) if p <= k else 0.0 for p in range(1, m + 1)]
    dcg, i = 0.0, 0
    while i < m:
        j = i
        while j + 1 < m and scores[order[j + 1]] == scores[order[i]]:
            j += 1
        grp = order[i:j + 1]
        dcg += sum(rel[g] for g in grp) / len(grp) * sum(disc[i:j + 1])
        i = j + 1
    ideal = sum(disc[:min(k, len(gold))])
    return dcg / ideal if ideal > 0 else 0.0


M = 10
NDCG = [
    ("N1", [(0, .9), (1, .8), (2, .7), (3, .6), (4, .5)], {1, 4}, 0.6240505200038379),
    ("N2", [(0, .9), (1, .8)], {1, 5}, 0.48783273620011863),
    ("N3", [(0, .9), (1, .8), (2, .8), (3, .6), (4, .5)], {1}, 0.5654648767857288),
    ("N4", [(0, .9)], set(), 0.0),
    ("N5", [], {3}, 0.29484591188793924),
]


def _frames(spark, cases):
    dic = spark.createDataFrame([(i, f"c{i}") for i in range(M)], "corpus_id long, text string")
    hits, tests = [], []
    for qid, (_, h, gold, _) in enumerate(cases):
        for rank, (pos, s) in enumerate(h, start=1):
            hits.append((qid, rank, f"c{pos}", float(s)))
        tests.append((qid, [f"c{g}" for g in sorted(gold)]))
    hits = spark.createDataFrame(hits, "query_id long, rank int, text string, score double")
    tests = spark.createDataFrame(tests, "query_id long, labels array<string>")
    return hits, tests, dic


def test_ndcg_goldens(spark):
    hits, tests, dic = _frames(spark, NDCG)
    got = {r.query_id: r.ndcg for r in ndcg_per_query(hits, tests, dic, M, 5).collect()}
    for qid, (name, h, gold, expected) in enumerate(NDCG):
        assert got[qid] == pytest.approx(expected, abs=1e-12), name
        assert plain_ndcg(h, gold, M) == pytest.approx(expected, abs=1e-12)


def test_micro_prf(spark):
    gold = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"]), (2, ["d", "zz"])],
                                 "query_id long, labels array<string>")
    pred = spark.createDataFrame([(0, "a"), (0, "x"), (1, "c"), (1, "y"), (2, "q")],
                                 "query_id long, text string")
    r = micro_prf(prediction_rows(pred), gold_rows(gold)).collect()[0]
    assert (r.tp, r.n_pred, r.n_gold) == (2, 5, 5)
    assert r.precision == pytest.approx(0.4) and r.recall == pytest.approx(0.4)
    assert r.f1 == pytest.approx(0.4)


def test_logged_values_reproduce():
    p, rec = 259 / 2500, 259 / 887
    assert p == 0.1036 and rec == 0.2919954904171364
    assert 2 * p * rec / (p + rec) == 0.15293770298198997


def test_percent4(spark):
    r = spark.createDataFrame([(0.30661,)], "x double").select(percent4(__import__("pyspark.sql.functions", fromlist=["col"]).col("x")).alias("y")).collect()[0]
    assert r.y == round(0.30661, 4) * 100 == 30.659999999999997
    assert not math.isnan(r.y)
