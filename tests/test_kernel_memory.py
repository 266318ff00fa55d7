"""The kernel's memory does not grow with the blocks of a batch; its draws are those of the whole matrix."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlab.functions import hashrand as hr
from pairlab.operators import blocks
from pairlab.operators.blocks import KernelSpec, similarity_kernel

DIM = 8


def _batch(n_left, n_targets, n_blocks):
    """One left block with several target blocks, as the kernel gets them."""
    rng = np.random.default_rng(0)
    lefts = pd.DataFrame({"key": range(n_left), "vec": list(rng.normal(size=(n_left, DIM))), "xh": 0, "xv": False, "xt": None,
                          "lo": 0.0, "rh": [[k * 7 + 1] for k in range(n_left)], "xs": None, "xsh": None})
    n = n_targets * n_blocks
    targets = pd.DataFrame({"corpus_id": range(n), "text": [f"t{i}" for i in range(n)], "th": 0,
                            "embedding": list(rng.normal(size=(n, DIM)))})
    left = next(blocks._pack_left_fn(DIM, n_left)(iter([lefts])))
    parts = pd.concat(list(blocks._pack_targets_fn(DIM, n_targets)(iter([targets]))))
    return left.merge(parts.rename(columns={"n": "n_t", "vecs": "vecs_t"}), how="cross")


@pytest.mark.parametrize("spec", [KernelSpec(mode="edges", min_score=0.9, clamp=True), KernelSpec(mode="rank", n=3, above=0.0),
                                  KernelSpec(mode="weighted", n=3, clamp=True, min_score=0.0, max_score=1.0)])
def test_a_batch_of_many_blocks_holds_one_score_matrix(spec):
    pairs = _batch(512, 1024, 24)
    batch = pa.RecordBatch.from_pandas(pairs, preserve_index=False)
    for given in (pairs, batch):
        tracemalloc.start()
        for _ in blocks._kernel_fn([spec], DIM)(iter([given])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * 512 * 1024 * 8  # eight of the 24 score matrices


def test_grid_cells_follow_the_work(spark, monkeypatch):
    """More scores make more cells and more tasks, not longer ones."""
    rng = np.random.default_rng(1)
    targets = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(200, DIM)))],
                                    "corpus_id long, text string, embedding array<double>")
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(100, DIM)))], "key long, vec array<double>")
    spec, opts = KernelSpec(mode="rank", n=3), dict(broadcast_limit=0, left_block=4, target_block=8)
    monkeypatch.setattr(blocks, "TASK_SCORES", 500)
    shapes, real = [], blocks._grid_pairs
    monkeypatch.setattr(blocks, "_grid_pairs", lambda a, b, g, h, **k: shapes.append(g * h) or real(a, b, g, h, **k))
    got = {r["key"]: r["ids"] for r in similarity_kernel(left, targets, spec, **opts).collect()}
    assert shapes[0] >= 100 * 200 // 500
    assert got == {r["key"]: r["ids"] for r in similarity_kernel(left, targets, spec).collect()}


@pytest.mark.parametrize("mode", ["weighted", "uniform"])
@pytest.mark.parametrize("low", [0.0, 0.4])
def test_draws_are_those_of_the_whole_matrix(spark, mode, low):
    rng = np.random.default_rng(3)
    t, v = rng.normal(size=(600, DIM)), rng.normal(size=(40, DIM))
    targets = spark.createDataFrame([(i, f"t{i}", x.tolist()) for i, x in enumerate(t)],
                                    "corpus_id long, text string, embedding array<double>")
    rows = [(k, v[k % 10].tolist(), k % 10, f"t{k}", [10 ** 15 + 977 * k]) for k in range(40)]
    left = spark.createDataFrame(rows, "key long, vec array<double>, anchor long, xt string, rh array<long>")
    left = left.withColumn("xh", F.xxhash64("xt")).coalesce(2)
    spec = KernelSpec(mode=mode, n=5, clamp=True, min_score=low, max_score=0.95)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.clip(unit(v[:10]) @ unit(t).T, 0.001, 1.0)
    for opts in ({}, dict(target_block=16, left_block=8), dict(broadcast_limit=0, target_block=64)):
        found = similarity_kernel(left, targets, spec, left_spread=True, **opts).collect()
        for r in found:
            k = r["key"]
            u = hr.pair_unit_np(np.int64(10 ** 15 + 977 * k), hr.wide_np(np.arange(600)))
            may = (s[k % 10] >= low) & (s[k % 10] <= 0.95) & (np.arange(600) != k)
            val = np.where(may, np.log(u) / s[k % 10] if mode == "weighted" else -u, -np.inf)
            best = np.lexsort((np.arange(600), -val))[:min(5, may.sum())]
            assert r["ids"] == best.tolist() and r["n_eligible"] == may.sum() and r["n_pool"] == 599
        assert len(found) == 40


def _draws(pairs, specs):
    out = [b for b in blocks._kernel_fn(specs, DIM)(iter([pairs]))]
    return pa.Table.from_batches(out).to_pylist()


@pytest.mark.parametrize("mode", ["weighted", "uniform"])
def test_a_draw_computes_few_keys_and_merges_once_a_chunk(monkeypatch, mode):
    """Most keys are known not to be among the best by half a hash, in the first block too; entries of a chunk's parts
    are merged together."""
    pairs = _batch(256, 2048, 4)
    specs = [KernelSpec(mode=mode, n=3, clamp=True, min_score=0.0), KernelSpec(mode="weighted", n=3, clamp=True, min_score=0.8)]
    keys, merges, unit, merge = [], [], hr.joined_unit_np, blocks._RowState.merge
    monkeypatch.setattr(hr, "joined_unit_np", lambda one, *a: keys.append(np.size(one)) or unit(one, *a))
    monkeypatch.setattr(blocks._RowState, "merge", lambda self, *a: merges.append(1) or merge(self, *a))
    want = _draws(pairs, specs[:1])
    assert sum(keys) < 0.05 * 256 * 8192 and len(merges) <= 4
    merges.clear()
    both = _draws(pairs, specs)
    assert len(merges) <= 2 * 4
    assert [r for r in both if r["spec"] == 0] == want


@pytest.mark.parametrize("mode", ["weighted", "uniform"])
@pytest.mark.parametrize("low", [0.0, None])
def test_a_guess_does_not_change_a_draw(monkeypatch, mode, low):
    """Whatever keys a row is asked for at first: none, too great ones, all."""
    pairs = _batch(64, 512, 3)
    spec = KernelSpec(mode=mode, n=4, clamp=True, min_score=0.0, use_row_lo=low is not None)
    want = _draws(pairs, [spec])
    assert all(len(r["ids"]) == 4 for r in want)
    for guess in (-1e-9, -1e-3, -1e3, -np.inf):
        monkeypatch.setattr(blocks, "_guess", lambda chunk, spec, guess=guess: np.full(len(chunk.scores), guess))
        for cut in (0.0, 1.0):
            monkeypatch.setattr(blocks, "PAIR_CUT", cut)
            assert _draws(pairs, [spec]) == want
