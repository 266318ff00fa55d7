"""Inputs unlike the fixture: duplicate and unknown texts, sparse ids, short rows, quoted files."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import mining as mn
from pairlab.operators.calibrate import EpochConfig, tune_beta
from pairlab.operators.encode import encode_distinct, mean_pool, trigram_encoder
from pairlab.operators.instances import build_instances
from pairlab.operators.losses import bidirectional_loss, in_batch_row_losses
from pairlab.operators.metrics import ndcg_per_query, similarity_correlation
from pairlab.operators.similarity import first_row_cosine, pair_cosine
from pairlab.plans.epoch import prepare_epoch, prepare_epoch_from_files
from pairlab.plans.evaluate import evaluate
from pairlab.session import ensure_checkpoint_dir
from pairlab.sources.readers import read_dictionary, read_pairs
from tests.oracle_check import compare

DICT = "corpus_id long, text string, embedding array<double>"
PAIRS = "row_id long, text1 string, text2 string, label double"


def test_pair_scores_with_duplicate_and_unknown_texts(spark):
    qs = spark.createDataFrame([(3, "x", [0.0, 1.0]), (1, "x", [1.0, 0.0]), (2, "y", [0.6, 0.8])], DICT)
    cs = spark.createDataFrame([(0, "a", [1.0, 0.0]), (9, "a", [0.0, 1.0])], DICT)
    pairs = spark.createDataFrame([(0, "x", "a", 1.0), (1, "y", "a", 0.0), (2, "new", "a", 1.0)], PAIRS)
    got = {r.row_id: r.score for r in pair_cosine(pairs, qs, cs).collect()}
    assert got == {0: pytest.approx(1.0), 1: pytest.approx(0.6), 2: None}
    first = {r.row_id: r.score for r in first_row_cosine(pairs, qs, cs).collect()}
    assert first == {i: pytest.approx(1.0) for i in range(3)}
    enc = trigram_encoder(2)
    seen = {r.row_id: r.score for r in pair_cosine(pairs, qs, cs, encoder=enc).collect()}
    assert seen[0] == pytest.approx(1.0) and seen[2] is not None
    beta = tune_beta(pair_cosine(pairs, qs, cs), 0.8).collect()[0]
    assert (beta["kept"], beta["positives"]) == (1, 1)       # one row each, none multiplied
    with pytest.raises(ValueError, match="1 validation pairs"):
        prepare_epoch(pairs.limit(1), pairs, qs, cs, EpochConfig.for_epoch(1))


def test_ladder_follows_scores_above_one(spark):
    df = spark.createDataFrame([(s, 0.0) for s in (0.6, 3.0, 7.5)], "score double, label double")
    r = tune_beta(df, 0.8).collect()[0]
    assert not r["reached"] and r["beta"] > 7.5 and r["beta"] < 7.5 + 3 * 0.015
    assert tune_beta(df.limit(0), 0.8).collect()[0]["beta"] == 0.5


def test_evaluate_refuses_or_encodes_unseen_queries(spark):
    enc = trigram_encoder(64)
    cands = encode_distinct(spark.createDataFrame([(0, "blue whale"), (1, "red fox")], "corpus_id long, text string"),
                            "text", enc)
    known = cands.limit(0)
    tests = spark.createDataFrame([(0, "blue whales", ["blue whale"]), (1, "red foxes", ["red fox"])],
                                  "query_id long, query string, labels array<string>")
    with pytest.raises(ValueError, match="2 test queries"):
        evaluate(tests, known, cands, 2)
    r = evaluate(tests, known, cands, 2, k=1, encoder=enc).collect()[0]
    assert (r["tp"], r["n_pred"], r["n_gold"]) == (2, 2, 2)


def test_fills_of_sparse_ids_and_near_constant_dictionary(spark):
    cands = spark.createDataFrame([(i * 100_000 - 300_000, f"c{i}", [1.0, float(i)]) for i in range(10)], DICT)
    qs = spark.createDataFrame([(0, "q", [1.0, 0.0])], DICT)
    pairs = spark.range(200).select(F.col("id").alias("row_id"), F.lit("q").alias("text1"), F.lit("c3").alias("text2"))
    r = mn.mine_negatives(pairs, qs, cands, method=mn.TOPK_EFN, positive_threshold=2.0, num_negatives=4, seed=1)
    got = r.negatives.groupBy("text").count().collect()
    assert sum(x["count"] for x in got) == 800 and {x["text"] for x in got} == {f"c{i}" for i in range(10) if i != 3}
    most = spark.createDataFrame([(i, "same", [1.0, 0.0]) for i in range(500)] + [(7000, "other", [0.0, 1.0])], DICT)
    one = pairs.withColumn("text2", F.lit("same"))
    assert {x["text"] for x in mn.easy_negatives(one, most, seed=2).collect()} == {"other"}
    assert mn.easy_negatives(one, most.filter("text = 'same'"), seed=2).count() == 0


def test_short_rows_keep_their_positive_pair(spark):
    cands = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], DICT)
    qs = spark.createDataFrame([(0, "p", [1.0, 0.1]), (1, "q", [0.1, 1.0])], DICT)
    pairs = spark.createDataFrame([(0, "p", "a", 1.0), (1, "q", "b", 1.0), (2, "none", "a", 1.0)], PAIRS)
    opts = dict(method=mn.TOPK, positive_threshold=0.9)       # no other candidate is that near
    drop = build_instances("contrastive", pairs, qs, cands, **opts)
    assert sorted(r["label"] for r in drop.instances.collect()) == [1.0, 1.0, 1.0] and drop.dropped.count() == 3
    fill = build_instances("contrastive", pairs, qs, cands, on_short="fill", **opts)
    assert sorted((r["row_id"], r["texts"][1]) for r in fill.instances.collect() if r["label"] == 0) == [
        (0, "b"), (1, "a"), (2, "b")] and fill.dropped.count() == 0
    tri = build_instances("triplet", pairs, qs, cands, on_short="fill", **opts)
    assert tri.instances.count() == 3


def test_missing_true_vector_makes_a_row_short(spark):
    cands = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.9, 0.1])], DICT)
    qs = spark.createDataFrame([(0, "p", [1.0, 0.0])], DICT)
    pairs = spark.createDataFrame([(0, "p", "unknown", 1.0), (1, "p", "b", 1.0)], PAIRS)
    r = mn.mine_negatives(pairs, qs, cands, method=mn.LARGER, positive_threshold=0.0, num_negatives=1)
    assert [(x.row_id, x.reason) for x in r.short.collect()] == [(0, "no_vector")]
    assert {x.row_id for x in r.negatives.collect()} == {1}


def test_losses_leave_out_whole_instances(spark):
    qv = spark.createDataFrame([(i, f"q{i}", [1.0, float(i)]) for i in range(3)], DICT)
    cv = spark.createDataFrame([(i, f"c{i}", [float(i), 1.0]) for i in range(3)], DICT)
    rows = [(0, 0, ["q0", "c0"]), (0, 1, ["q1", "missing"]), (0, 2, ["q2", "c2"])]
    schema = "batch_id long, pos int, texts array<string>"
    got = {r.pos: r for r in in_batch_row_losses(spark.createDataFrame(rows, schema), qv, cv, 0, 1.0).collect()}
    want = {r.pos: r for r in in_batch_row_losses(spark.createDataFrame(
        [(0, 0, ["q0", "c0"]), (0, 1, ["q2", "c2"])], schema), qv, cv, 0, 1.0).collect()}
    assert got[1].forward is None and got[1].backward is None
    for a, b in ((0, 0), (2, 1)):
        assert (got[a].forward, got[a].backward) == (pytest.approx(want[b].forward), pytest.approx(want[b].backward))
    batch = bidirectional_loss(spark.createDataFrame(rows, schema), qv, cv, 0, 1.0).collect()[0]
    assert batch["n"] == 2 and not math.isnan(batch["loss"])


def test_ndcg_by_id_equals_ndcg_by_text(spark):
    dic = spark.createDataFrame([(i, f"t{i % 4}") for i in range(9)], "corpus_id long, text string")
    hits = spark.createDataFrame([(0, 1, 5, "t1", 0.9), (0, 2, 2, "t2", 0.8), (1, 1, 8, "t0", 0.5)],
                                 "query_id long, rank int, corpus_id long, text string, score double")
    tests = spark.createDataFrame([(0, ["t1"]), (1, ["t3", "oov"])], "query_id long, labels array<string>")
    a = sorted(map(tuple, ndcg_per_query(hits, tests, dic, 9).collect()))
    assert a == sorted(map(tuple, ndcg_per_query(hits.drop("corpus_id"), tests, dic, 9).collect()))


def test_correlation_against_pandas(spark):
    rows = [(float(i % 7) / 7, float((i * i) % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "score double, label double")
    p = df.toPandas()
    got = similarity_correlation(df).collect()[0]
    assert got["pearson"] == pytest.approx(p["score"].corr(p["label"]))
    assert got["spearman"] == pytest.approx(p["score"].rank().corr(p["label"].rank()))
    assert similarity_correlation(df.limit(1)).collect()[0]["pearson"] is None


def test_hot_tokens_change_nothing(spark, monkeypatch):
    from pairlab.operators import encode
    docs = spark.createDataFrame([(i, "the " * (i % 3 + 1) + f"w{i}") for i in range(40)], "k long, text string")
    tv = encode.token_table(docs, "text", trigram_encoder(8))
    a = {r.k: (r.n_tokens, list(r.embedding)) for r in mean_pool(docs, "k", "text", tv).collect()}
    monkeypatch.setattr(encode, "HOT_DOCS", 5)
    b = {r.k: (r.n_tokens, list(r.embedding)) for r in mean_pool(docs, "k", "text", tv).collect()}
    assert {k: (n, pytest.approx(v)) for k, (n, v) in a.items()} == b


def test_frequent_tokens_are_pooled_where_the_texts_lie(spark, monkeypatch):
    """No table has a row for each document and frequent token; odd rows and vectors count as in a join."""
    from pairlab.operators import encode
    rows = [(i % 290, " ".join(f"w{(i * 7 + j) % 40}" for j in range(30)) + f" rare{i} none") for i in range(300)]
    rows += [(None, "w1 w2"), (1000, None), (1001, " "), (1002, "none")]
    docs = spark.createDataFrame(rows, "k long, text string")
    words = [f"w{j}" for j in range(40)] + ["w3", None] + [f"rare{i}" for i in range(300)]
    vec = {(w, n): np.random.default_rng(n).normal(size=8) for n, w in enumerate(words)}
    tv = spark.createDataFrame([(w, v.tolist()) for (w, _), v in vec.items()], "token string, embedding array<double>")
    sizes, real = [], encode.materialize
    monkeypatch.setattr(encode, "materialize", lambda df: (lambda out: sizes.append(out.count()) or out)(real(df)))
    got = mean_pool(docs, "k", "text", tv).collect()
    assert max(sizes) <= len(words) + len(rows)
    assert sorted((r.k is None, r.k) for r in got if r.k is not None) == sorted((False, k) for k, _ in rows if k is not None)
    for r in got:
        own = [v for k, t in rows if k is not None and k == r.k and t for w in t.split() for (x, _), v in vec.items() if x == w]
        assert r.n_tokens == len(own)
        assert list(r.embedding) == pytest.approx(list(np.mean(own, axis=0)) if own else [0.0] * 8)


def _folder(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    return str(tmp_path)


def test_pairs_by_name_with_quotes_and_over_files(spark, tmp_path):
    d = _folder(spark, tmp_path)
    for i, body in enumerate(['1\t"a, ""b"""\tx\n0\tplain\t"tab\tin"\n', "1\tsecond\tz\n"]):
        with open(f"{d}/part-{i}.tsv", "w") as f:
            f.write("label\ttext1\ttext2\n" + body)
    got = read_pairs(spark, d).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(0, 'a, "b"', "x", 1.0), (1, "plain", "tab\tin", 0.0), (2, "second", "z", 1.0)]
    with open(f"{d}/bad.tsv", "w") as f:
        f.write("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="text1"):
        read_pairs(spark, f"{d}/bad.tsv")


def test_dictionary_positions_follow_files_and_lines(spark, tmp_path):
    d = _folder(spark, tmp_path)
    for i in (2, 0, 1):
        with open(f"{d}/{i}.txt", "w") as f:
            f.write("".join(f"entry {i}-{k}\n" for k in range(5)))
    got = [r.text for r in read_dictionary(spark, d).orderBy("corpus_id").collect()]
    assert got == [f"entry {i}-{k}" for i in range(3) for k in range(5)]


def test_epoch_from_files(spark, tmp_path):
    d = _folder(spark, tmp_path)
    cands = [f"entry number {i} about {w}" for i, w in enumerate(["whales", "foxes", "birds", "trees", "rivers", "stars"])]
    for name, rows in (("cands", cands), ("queries", [c.replace("entry", "note") for c in cands])):
        with open(f"{d}/{name}.txt", "w") as f:
            f.write("\n".join(rows) + "\n")
    with open(f"{d}/pairs.tsv", "w") as f:
        f.write("text1\ttext2\tlabel\n" + "".join(f"unseen note {i} {c}\t{c}\t1\n" for i, c in enumerate(cands)))
    for recipe in ("bidirectional", "triplet"):
        cfg = EpochConfig.for_recipe(recipe, 0, num_hard_negative_queries=2, num_hard_negative_candidates=2)
        e = prepare_epoch_from_files(spark, f"{d}/pairs.tsv", f"{d}/pairs.tsv", f"{d}/cands.txt", f"{d}/queries.txt",
                                     trigram_encoder(32), cfg)
        assert e.instances.count() == 6 and e.dropped.count() == 0
    assert EpochConfig.for_recipe("contrastive", 2, False).train_batch_size == 64
    assert EpochConfig.for_recipe("one_way", 2, False).num_hard_negative_candidates == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    from pairlab import session
    monkeypatch.setattr(session, "ship_package", lambda s: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_windowed_quality_of_a_table_longer_than_any_fixture(spark, tmp_path):
    """Events over 20 times the fixture's span, in files that each cover all of it: none is dropped as late."""
    sf = "/root/testdata/sf0.001"
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    ev = spark.read.parquet(f"{sf}/events.parquet")
    kind = ev.schema["ts"].dataType
    at, first = F.unix_timestamp(F.col("ts").cast("timestamp")), ev.agg(F.min(F.col("ts").cast("timestamp"))).first()[0]
    start = F.unix_timestamp(F.lit(first))
    ev = ev.withColumn("ts", F.timestamp_seconds(start + (at - start) * 20).cast(kind))
    assert ev.agg(F.max("ts") - F.min("ts")).first()[0].days > 60
    ev.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    res = compare(spark, str(tmp_path), ["t2_windowed_quality"], verbose=False)
    assert res["t2_windowed_quality"][0] is True, res
