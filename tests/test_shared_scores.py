"""Distinct anchors, cap bounds, packed dictionaries, schedules in one pass, sinks and stream counts."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import blocks
from pairlab.operators.blocks import KernelSpec, packed_targets, read_packed, similarity_kernel
from pairlab.operators.calibrate import EpochConfig
from pairlab.operators.mining import METHODS, mine_negatives
from pairlab.operators.similarity import by_anchor, similarity_edges, top_k_join
from pairlab.plans import epoch as plans
from pairlab.plans.evaluate import append_results, read_results
from pairlab.session import ensure_checkpoint_dir, materialize
from pairlab.sources.fixtures import vector_fixture
from pairlab.streaming.search import quality_stream, rolling_quality, run_to_completion, search_stream

SF = "/root/testdata/sf0.001"
DICT = "corpus_id long, text string, embedding array<double>"


def _folder(spark, name):
    base = ensure_checkpoint_dir(spark)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=base if os.path.isdir(base) else None)


def _dictionary(spark, vectors, name="t"):
    return spark.createDataFrame([(i, f"{name}{i}", v.tolist()) for i, v in enumerate(vectors)], DICT)


def test_a_repeated_anchor_is_scored_once(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 8))
    rows = [(i, "hot" if i < 1000 else f"a{i % 50}") for i in range(1300)]
    vec = {t: rng.normal(size=8).tolist() for _, t in rows}
    df = spark.createDataFrame([(i, t, vec[t]) for i, t in rows], "row_id long, text1 string, vec array<double>")
    dealt = by_anchor(df, "text1", "row_id", 8).select(
        F.col("row_id").alias("key"), "anchor", "vec", F.lit(0).cast("long").alias("xh"), F.lit(None).cast("string").alias("xt"))
    left = dealt.select("key", "vec", "xh", F.lit(False).alias("xv"), "xt", F.lit(0.0).alias("lo"),
                        F.array(F.lit(0).cast("long")).alias("rh"), F.lit(None).cast("array<string>").alias("xs"),
                        F.lit(None).cast("array<long>").alias("xsh"), "anchor")
    packed = left.sortWithinPartitions("anchor", "key").drop("anchor").mapInPandas(
        blocks._pack_left_fn(8, 1024), blocks.LEFT_BLOCK_SCHEMA).agg(F.sum("na"), F.sum("n")).first()
    assert tuple(packed) == (51, 1300)
    got = similarity_edges(dealt.drop("xh", "xt"), _dictionary(spark, vectors), 0.3, left_spread=True)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    s = {t: unit(vectors) @ unit(np.array(v)) for t, v in vec.items()}
    want = sorted((i, j) for i, t in rows for j in range(40) if s[t][j] >= 0.3)
    assert sorted((r["key"], r["target_id"]) for r in got.collect()) == want


def test_anchors_with_very_many_rows_are_dealt_to_several_tasks(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.col("id").cast("string")).alias("text1"))
    sizes = by_anchor(df, "text1", "row_id", 8).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) < 10_000


@pytest.mark.parametrize("method", METHODS)
def test_rows_of_one_anchor_get_what_single_rows_get(spark, method):
    """Repeated anchors with different excluded texts, bounds and draws: the same as each row alone."""
    fx = vector_fixture(spark, SF)
    pairs = fx.training.select("row_id", "text1", "text2").limit(12).collect()
    rows = [(100 * i + j, p["text1"], q["text2"]) for i, p in enumerate(pairs[:4]) for j, q in enumerate(pairs)]
    df = spark.createDataFrame(rows, "row_id long, text1 string, text2 string")
    opts = dict(method=method, positive_threshold=0.05, beta=0.6, num_negatives=4, seed=3, epoch=1)
    both = mine_negatives(df, fx.queries, fx.candidates, **opts).negatives
    alone = mine_negatives(df.filter("row_id % 100 = 5"), fx.queries, fx.candidates, left_block=1, **opts).negatives
    cols = ["row_id", "slot", "target_id", "text", "is_fill"]
    assert sorted(map(tuple, both.filter("row_id % 100 = 5").select(*cols).collect())) == \
        sorted(map(tuple, alone.select(*cols).collect()))


# ---------------------------------------------------------------- caps
def _clustered(n_clusters=24, each=60, dim=16):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(n_clusters, dim))
    return np.repeat(centers, each, axis=0) + 0.05 * rng.normal(size=(n_clusters * each, dim))


@pytest.mark.parametrize("spec", [KernelSpec(mode="rank", n=5, above=0.8, counts=False),
                                  KernelSpec(mode="rank", n=5, counts=False), KernelSpec(mode="edges", min_score=0.9)])
def test_pairs_of_far_blocks_are_passed_over(spark, spec):
    vectors = _clustered()
    targets = _dictionary(spark, vectors)
    packed = packed_targets(targets, clusters=24, target_block=60)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[::5])], "key long, vec array<double>")
    lefts = left.selectExpr("key", "vec", "0L xh", "false xv", "cast(null as string) xt", "0D lo", "array(0L) rh",
                            "cast(null as array<string>) xs", "cast(null as array<long>) xsh")
    lblocks = lefts.coalesce(1).mapInPandas(blocks._pack_left_fn(16, 12), blocks.LEFT_BLOCK_SCHEMA)
    tblocks = packed.blocks.withColumnsRenamed({"n": "n_t", "vecs": "vecs_t"})
    pairs = lblocks.toPandas().merge(tblocks.toPandas(), how="cross")
    skipped: list = []
    list(blocks._kernel_fn([spec], 16, skipped)([pairs]))
    assert np.mean(skipped) > 0.5
    # with or without clusters and caps the result is that of the whole matrix
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = unit[::5] @ unit.T
    for given in (packed, targets):
        out = similarity_kernel(left, given, spec)
        if spec.mode == "edges":
            got = sorted((r["key"], r["target_id"]) for r in out.collect())
            assert got == sorted(zip(*map(list, np.nonzero(s >= 0.9))))
        else:
            got = {r["key"]: r["ids"] for r in out.collect()}
            for i, row in enumerate(s):
                best = [j for j in np.lexsort((np.arange(len(row)), -row)) if spec.above is None or row[j] > spec.above][:5]
                assert got[i] == best


def test_caps_bound_every_score():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (blocks._unit_rows(rng.normal(size=(rng.integers(1, 6), 4)) * (rng.random((1, 4)) < 0.8)) for _ in "ab")
        a[0] *= rng.random() < 0.9  # now and then a zero vector
        (c, r), (d, q) = blocks._cap(a), blocks._cap(b)
        pair = blocks._Pair.__new__(blocks._Pair)
        pair.row = {"center": c.tobytes(), "reach": r, "center_l": d.tobytes(), "reach_l": q}
        assert (a @ b.T).max() <= pair.bound()


# ---------------------------------------------------------------- packed dictionaries
def test_a_written_index_is_searched_like_the_dictionary(spark):
    rng = np.random.default_rng(5)
    targets = _dictionary(spark, rng.normal(size=(300, 8)))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 8)))],
                                    "query_id long, embedding array<double>")
    path = _folder(spark, "index")
    packed_targets(targets, clusters=8, target_block=64, path=f"{path}/v1")
    hits = lambda df: sorted((*r[:-1], round(r[-1], 12)) for r in map(tuple, df.collect()))
    want = hits(top_k_join(queries, targets))
    read = read_packed(spark, f"{path}/v1")
    assert read.stats.count == 300
    for opts in ({}, {"broadcast_limit": 0}):
        assert hits(top_k_join(queries, read, **opts)) == want
    empty = packed_targets(targets.limit(0))
    assert top_k_join(queries, empty).count() == 0


def test_a_stream_packs_its_dictionary_once(spark, monkeypatch):
    calls = []
    real = blocks.pack_targets
    monkeypatch.setattr(blocks, "pack_targets", lambda *a, **k: calls.append(1) or real(*a, **k))
    rng = np.random.default_rng(6)
    root = _folder(spark, "t1")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], "id long, embedding array<double>")
    rows.repartition(4, "id").write.parquet(f"{root}/in")
    run_to_completion(search_stream(spark, f"{root}/in", rows.schema, _dictionary(spark, rng.normal(size=(30, 8))),
                                    f"{root}/out", f"{root}/state", key="id"))
    batches = spark.read.parquet(f"{root}/out").select("batch").distinct().count()
    assert batches > 1 and len(calls) == 1


# ---------------------------------------------------------------- schedules
def test_schedule_equals_single_epochs_with_two_kernel_passes(spark, monkeypatch):
    from pairlab.operators import mining
    fx = vector_fixture(spark, SF)
    configs = [EpochConfig.for_epoch(e, seed=3, sampling_method=m)
               for e, m in enumerate(("multinomial", "multinomial_with_E-FN", "topK_with_E-FN"))]
    args = fx.training, fx.validation, fx.queries, fx.candidates
    passes, real = [], mining.similarity_kernel
    monkeypatch.setattr(mining, "similarity_kernel", lambda *a, **k: passes.append(1) or real(*a, **k))
    every = plans.prepare_epochs(*args, configs)
    assert len(passes) == 2
    for cfg, data in zip(configs, every):
        one = plans.prepare_epoch(*args, cfg)
        assert (data.tuned_beta, data.beta) == (one.tuned_beta, one.beta)
        cols = ["instance_id", "row_id", "texts", "batch_id", "pos"]
        assert sorted(map(str, data.instances.select(*cols).collect())) == sorted(map(str, one.instances.select(*cols).collect()))
    with pytest.raises(ValueError):
        plans.prepare_epochs(*args, [configs[0], EpochConfig.for_epoch(1, seed=4)])


# ---------------------------------------------------------------- sinks
def test_writing_twice_leaves_the_rows_once(spark):
    fx = vector_fixture(spark, SF)
    out = _folder(spark, "epochs")
    for e in (0, 1, 1):
        data = plans.prepare_epoch(fx.training, fx.validation, fx.queries, fx.candidates,
                                   EpochConfig.for_epoch(e, seed=3), output_path=out)
    back = spark.read.parquet(f"{out}/instances").groupBy("epoch").count().collect()
    assert {r["epoch"]: r["count"] for r in back}[1] == data.instances.count() and len(back) == 2
    log = _folder(spark, "log")
    for run, e, v in (("007", 0, 0.1), ("b", 0, 0.2), ("b", 1, 0.3), ("007", 0, 0.4)):
        append_results(spark.range(1).select(F.lit(v).alias("ndcg")), log, run, "m", e)
    rows = sorted((r["run_id"], r["epoch"], r["model"], r["ndcg"]) for r in read_results(spark, log).collect())
    assert rows == [("007", 0, "m", 0.4), ("b", 0, "m", 0.2), ("b", 1, "m", 0.3)]


# ---------------------------------------------------------------- streams
@pytest.mark.parametrize("with_time", [False, True])
def test_counts_do_not_depend_on_batch_borders(spark, with_time):
    rng = np.random.default_rng(7)
    targets = _dictionary(spark, rng.normal(size=(20, 8)))
    rows = [(i, [f"t{i % 20}", "unknown"][:1 + i % 2], rng.normal(size=8).tolist(), 1000 + 60 * i) for i in range(14)]
    rows += [(7, ["t3"], rows[7][2], rows[7][3])]  # a key again, with other labels
    again = [rows[5], rows[9]]                     # rows delivered twice
    found = set()
    for files in (1, 2, 7):
        root = _folder(spark, "t2")
        df = spark.createDataFrame(rows + again, "query_id long, labels array<string>, embedding array<double>, ts long")
        df = df.withColumn("ts", F.timestamp_seconds("ts"))
        df.repartition(files).write.parquet(f"{root}/in")
        opts = dict(ts_col="ts", watermark="1 hour") if with_time else {}
        run_to_completion(quality_stream(spark, f"{root}/in", df.schema, targets, f"{root}/out", f"{root}/state", **opts))
        found.add(tuple(rolling_quality(spark, f"{root}/out").select("tp", "n_pred", "n_gold").first()))
    (got,) = found
    given = rows if with_time else rows + again
    assert got[2] == sum(len(r[1]) for r in given)
    assert materialize(spark.read.parquet(f"{root}/out")).count() == len(given)


@pytest.mark.parametrize("clash", [False, True])
def test_a_question_asked_often_is_scored_once_a_batch(spark, monkeypatch, clash):
    """Rows with equal vector and labels share one scoring; labels that differ only in the place of a null have one
    hash and stay apart all the same."""
    from pairlab.streaming import search
    rng = np.random.default_rng(9)
    targets = _dictionary(spark, rng.normal(size=(20, 8)))
    vec, labels = rng.normal(size=(3, 8)), [["t1", "t2"], [None, "t3"] if clash else ["t3"], []]
    rows = [(i, labels[i % 3], vec[i % 3].tolist(), 1000 + i) for i in range(300)]
    rows += [(300 + i, ["t3", None], vec[1].tolist(), 2000) for i in range(5 * clash)]
    df = spark.createDataFrame(rows, "query_id long, labels array<string>, embedding array<double>, ts long")
    df = df.withColumn("ts", F.timestamp_seconds("ts"))
    scored, real = [], search.top_k_join
    monkeypatch.setattr(search, "top_k_join", lambda q, *a, **k: scored.append(q.count()) or real(q, *a, **k))
    root = _folder(spark, "t2")
    df.repartition(2).write.parquet(f"{root}/in")
    run_to_completion(quality_stream(spark, f"{root}/in", df.schema, targets, f"{root}/out", f"{root}/state", ts_col="ts"))
    assert scored == [3 + clash] * 2
    hits = {(r["q"], r["text"]) for r in real(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)],
                                                                   "q long, embedding array<double>"), targets, key="q").collect()}
    n_pred = [sum(1 for q, _ in hits if q == i) for i in range(3)]
    got = {r["query_id"]: (r["tp"], r["n_pred"], r["n_gold"]) for r in spark.read.parquet(f"{root}/out").collect()}
    assert len(got) == len(rows)
    for i, gold, _, _ in rows:
        q = i % 3 if i < 300 else 1
        assert got[i] == (sum((q, t) in hits for t in gold), n_pred[q], len(gold))
