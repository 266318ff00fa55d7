"""The kernel's result depends neither on ids and keys nor on the join that AQE picks."""

import numpy as np
import pytest

from pairlab.operators import blocks
from pairlab.operators.similarity import top_k_join

DICT = "corpus_id long, text string, embedding array<double>"
IDS = [-5, -(2 ** 40), 0, 1, 7, 7, 100_000, 2 ** 50]


def _tables(spark, n_left=300, n_targets=90, dim=8):
    rng = np.random.default_rng(0)
    t = rng.normal(size=(n_targets, dim))
    ids = [IDS[i] if i < len(IDS) else 1000 + 17 * i for i in range(n_targets)]
    q = rng.normal(size=(n_left, dim))
    keys = [k // 2 for k in range(n_left)]            # every key twice, with different vectors
    targets = spark.createDataFrame([(int(a), f"t{i}", v.tolist()) for i, (a, v) in enumerate(zip(ids, t))], DICT)
    left = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, q)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(q) @ unit(t).T
    want = []
    for i, k in enumerate(keys):
        order = sorted((j for j in range(n_targets) if s[i, j] > 0), key=lambda j: (-s[i, j], ids[j]))[:5]
        want += [(k, r, ids[j], f"t{j}", round(s[i, j], 9)) for r, j in enumerate(order, 1)]
    return left, targets, sorted(want)


@pytest.mark.parametrize("opts", [
    {}, dict(target_block=7, left_block=13), dict(broadcast_limit=0, target_block=1000, left_block=64),   # H = 1
    dict(broadcast_limit=0, target_block=16, left_block=37, grid_tasks=64)])
def test_negative_sparse_and_repeated_ids(spark, opts):
    left, targets, want = _tables(spark)
    got = sorted((r.query_id, r["rank"], r.corpus_id, r.text, round(r.score, 9))
                 for r in top_k_join(left, targets, k=5, **opts).collect())
    assert got == want


def test_same_rows_when_aqe_splits_the_grid_join(spark):
    left, targets, want = _tables(spark, 600)
    held = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.0")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
        for opts in (dict(target_block=9), dict(target_block=9, grid_tasks=2)):
            got = sorted((r.query_id, r["rank"], r.corpus_id, r.text, round(r.score, 9)) for r in top_k_join(
                left, targets, k=5, broadcast_limit=0, left_block=16, **opts).collect())
            assert got == want
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_block_numbers_leave_room_for_the_rows():
    assert blocks.MAX_LEFT_BLOCK * ((1 << 20) << 30) <= 2 ** 62
