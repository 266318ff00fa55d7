"""Line dedup and the n-gram join: what does not grow with the pairs of a large group, and which tables stay."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pairlab.llm import line_dedup, signature_join
from pairlab.llm.components import connected_components
from pairlab.session import ensure_checkpoint_dir


@pytest.fixture(scope="module", autouse=True)
def _shared(spark):
    ensure_checkpoint_dir(spark)


def _variants(rng, n, changed, words=60):
    """Copies of one line, in each of which other words are replaced."""
    base = [f"{rng.randrange(10 ** 6):06d}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(words), changed):
            own[k] = f"{rng.randrange(10 ** 6):06d}"
        yield " ".join(own)


def _similarity(one, two, size=8):
    a, b = ({x[i:i + size] for i in range(len(x) - size + 1)} for x in (one, two))
    return len(a & b) / len(a | b)


def test_lines_that_stay_apart_are_not_counted_out(spark, monkeypatch):
    """Lines of one bucket that are far from similar: their pairs are not verified, the similar ones are linked."""
    rng = random.Random(5)
    lines = [*_variants(rng, 60, 12), *_variants(rng, 20, 1)]
    df = spark.createDataFrame(list(enumerate(lines)), "lh long, line string")
    mins = df.select("lh", *[F.lit(0).alias(m) for m in line_dedup._MINS])
    seen, real = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, texts: seen.append(pairs.count()) or real(pairs, texts))
    links = line_dedup._links(df.select(F.lit(1).cast("long").alias("bucket"), "lh"), df, mins)
    got = {r["node"]: r["label"] for r in connected_components(links).collect()}
    assert got == {i: 60 for i in range(60, 80)}
    assert sum(seen) < 300  # of 3,160 pairs


def test_pairs_that_cannot_be_similar_are_no_rows(spark, monkeypatch):
    """Lines of one bucket that stay apart: their pairs are neither written nor shuffled."""
    rng = random.Random(8)
    df = spark.createDataFrame(list(enumerate([*_variants(rng, 90, 12), *_variants(rng, 20, 1)])), "lh long, line string")
    mins = df.select("lh", *[F.lit(0).alias(m) for m in line_dedup._MINS])
    rows, real = [], line_dedup.written

    def counted(table):
        out = real(table)
        rows.append(out.count() if out.columns == ["a", "b"] else 0)
        return out
    monkeypatch.setattr(line_dedup, "written", counted)
    links = line_dedup._links(df.select(F.lit(1).cast("long").alias("bucket"), "lh"), df, mins)
    assert {r["node"]: r["label"] for r in connected_components(links).collect()} == {i: 90 for i in range(90, 110)}
    assert max(rows) < 600  # of 5,995 pairs


def test_signatures_are_those_of_all_shingles(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9)))
    lines = [" ".join(word() for _ in range(k)) for k in (1, 3, 9, 12, 40, 80, 200, 1000)] + ["a" * 100, "a" * 10000, "ab " * 700, "x", "é𝔘" * 200]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "lh long, line string")
    wide = df.select("lh", *line_dedup._widened(F.col("line")))
    hashed = line_dedup._windows(wide, "lh").select("lh", F.hash("window").cast("long").bitwiseAND(F.lit((1 << 32) - 1)).alias("h"))
    want = {r["lh"]: r for r in line_dedup._least(hashed, "lh").collect()}
    got = line_dedup.signatures(df).collect()
    assert len(got) == len(lines) and {r["lh"]: r for r in got} == want
    assert want[8][1:] == want[9][1:]


def test_bitmaps_let_no_similar_pair_go(spark):
    rng = random.Random(6)
    lines = [x for k in range(1, 7) for x in _variants(rng, 8, k)] + ["short", "short line", "ab " * 900, "ab " * 40, "é𝔘" * 30]
    df = spark.createDataFrame(list(enumerate(lines)), "lh long, line string")
    pairs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines))]
    asked = spark.createDataFrame(pairs, "a long, b long")
    may = {tuple(r) for r in line_dedup.possible(asked, line_dedup.bitmaps(df)).collect()}
    similar = {tuple(r) for r in line_dedup.verified(asked, df).collect()}
    assert similar <= may and len(similar) > 20
    assert {(i, j) for i, j in pairs[:1000] if _similarity(lines[i], lines[j]) >= 0.8} <= may


def _large_group(rng):
    """Sets with one passage in common, so that all are of one group: few of them are linked."""
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([f"w{rng.randrange(10 ** 6)}" for _ in range(60)] + passage) for _ in range(150)]
    for k in range(20):  # linked pairs
        words = texts[k].split()
        words[5] = "other"
        texts.append(" ".join(words))
    return texts


def _grouped(spark, texts):
    import pyarrow as pa
    sets = signature_join.shingle_sets(pa.array(texts), 3)
    rows = [(1, signature_join.set_key(s), bytearray(s.tobytes())) for s in sets]
    return sets, spark.createDataFrame(rows, "grp long, key long, items binary")


def _brute(sets, percent):
    keys = [signature_join.set_key(s) for s in sets]
    return {frozenset((keys[i], keys[j])) for i in range(len(sets)) for j in range(i)
            if signature_join._linked(sets[i], sets[j], percent)}


def test_a_large_group_is_thinned_to_what_may_be_linked(spark):
    sets, df = _grouped(spark, _large_group(random.Random(7)))
    left = signature_join._thinned(df, 90, 20_000).collect()
    linked = {k for pair in _brute(sets, 90) for k in pair}
    assert len(linked) == 40 and linked == {r["key"] for r in left}
    groups = {r["key"]: r["grp"] for r in left}
    assert all(len({groups[k] for k in pair}) == 1 for pair in _brute(sets, 90))
    assert len(set(groups.values())) > 10
    assert signature_join._thinned(df, 90, 8 << 20).count() == len(sets)  # not large: left alone


@pytest.mark.parametrize("copies", [2, 0.2])
def test_blocks_of_a_large_group_in_rounds(spark, monkeypatch, copies):
    monkeypatch.setattr(signature_join, "ROUND_COPIES", copies)
    sets, df = _grouped(spark, _large_group(random.Random(8)))
    links = {frozenset((r["a"], r["b"])) for r in signature_join._links(df, 90, 20_000).collect()}
    assert links == _brute(sets, 90)


def test_only_results_stay_in_the_shared_folder(spark):
    """The tables that the searches write go with them."""
    root = f"{ensure_checkpoint_dir(spark)}/pairlab-{spark.sparkContext.applicationId}"
    tables = lambda: set(os.listdir(root.removeprefix("file:"))) if os.path.isdir(root.removeprefix("file:")) else set()
    docs = spark.createDataFrame([(i, f"a line of text number {i % 3} that is long\nand one more {i}") for i in range(9)],
                                 "doc_id long, text string")
    before = tables()
    assert line_dedup.dedup_lines(docs).count() == 9
    assert len(tables() - before) == 1
    before = tables()
    assert signature_join.keep_one(docs).count() <= 9
    assert len(tables() - before) <= 3
