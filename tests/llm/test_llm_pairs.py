"""Nearest neighbours, line dedup, n-gram join, components and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
import corpus_pipeline
from pairlab.llm import ann_forest, line_dedup, signature_join
from pairlab.llm.components import connected_components
from pairlab.session import ensure_checkpoint_dir

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, mark string, id int, key int"


@pytest.fixture(scope="module", autouse=True)
def _shared(spark):
    ensure_checkpoint_dir(spark)


def _find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(5, 5)]
    edges += [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    parent = list(range(6000))
    for a, b in edges:
        x, y = _find(parent, a), _find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: _find(parent, x) for x in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- nearest neighbours
def _exact(ids, vectors, query, k):
    scores = vectors @ vectors[query]
    order = sorted((i for i in range(len(ids)) if i != query), key=lambda i: (-scores[i], ids[i]))[:k]
    return [ids[i] for i in order]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_nearest_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    at = {v: i for i, v in enumerate(ids)}
    found = defaultdict(list)
    for r in se.queries()["op4_ann"](spark, sf).orderBy("rank").collect():
        assert r["score"] == pytest.approx(float(vectors[at[r["vec_id"]]] @ vectors[at[r["query_id"]]]), abs=1e-12)
        found[r["query_id"]].append(r["vec_id"])
    queries = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert set(found) == {ids[q] for q in queries}
    hits = sum(len(set(found[ids[q]]) & set(_exact(ids, vectors, q, 20))) for q in queries)
    assert hits >= 0.9 * 20 * len(queries)


def test_nearest_over_several_blocks(spark):
    """Blocks smaller than the least number of candidates are searched whole, so the result is exact."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    df = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in rows], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in ann_forest.nearest(df, F.col("vec_id") % 20 == 0, block_bytes=60_000).orderBy("rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    queries = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert {ids[q]: _exact(ids, vectors, q, 20) for q in queries} == found


def test_nearest_odd_vectors_and_ties(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.0], "c") for i in range(0, 50)] + [
        (60, [2.0, 0.0], "c"), (61, None, "c"), (62, [0.0, 0.0], "c"), (63, [1.0, None], "c"), (64, [inf, 1.0], "c"),
        (65, [nan, 1.0], "c"), (66, [], "c"), (67, [1.0, 2.0, 3.0], "c"), (None, [1.0, 0.0], "c"), (80, [1.0, 0.0], "c"),
        (80, [1.0, 0.0], "c"), (100, [-1.0, 0.5], "c"), (120, None, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in ann_forest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 60, 80, 100}
    assert got[0] == [(60, 2.0)] + [(i, 1.0) for i in range(1, 20)]
    assert got[60] == [(i, 2.0) for i in range(20)]
    assert got[80] == [(60, 2.0)] + [(i, 1.0) for i in range(19)]
    assert got[100] == [(i, -1.0) for i in range(20)]
    assert ann_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    two = ann_forest.nearest(df.filter("vec_id in (0, 60)"), F.col("vec_id") % 20 == 0).collect()
    assert len(two) == 2


# ---------------------------------------------------------------- line dedup
def _line_brute(rows, shingle=8, percent=80):
    """Remaining text of each distinct (id, text)."""
    where = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\f\v"):
                where[line].append((n, p))
    lines = list(where)
    sets = [{x[i:i + shingle] for i in range(max(1, len(x) - shingle + 1))} for x in lines]
    holders, parent = defaultdict(list), list(range(len(lines)))
    for k, own in enumerate(sets):
        shared = Counter(j for w in own for j in holders[w])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                x, y = _find(parent, k), _find(parent, j)
                parent[max(x, y)] = min(x, y)
        for w in own:
            holders[w].append(k)
    first = {}
    for k, line in enumerate(lines):
        root = _find(parent, k)
        first[root] = min(first.get(root, where[line][0]), where[line][0])
    of = {line: _find(parent, k) for k, line in enumerate(lines)}
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if x not in of or first[of[x]] == (n, p))
            if t is not None else None for n, (_, t) in enumerate(rows)]


def test_line_dedup_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    want = _line_brute(rows)
    same = sum(got[i] == t for (i, _), t in zip(rows, want))
    assert same >= 0.995 * len(rows)  # signatures may miss a pair
    assert all(len(got[i]) >= len(t) for (i, _), t in zip(rows, want))  # and never remove another line


def test_line_dedup_odd_rows_and_large_buckets(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    base = [rng.choice(words) for _ in range(60)]
    lines = []
    for i in range(40):  # near copies of one line
        own = list(base)
        own[rng.randrange(60)] = f"w{i}"
        lines.append(" ".join(own))
    long = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(30_000))
    rows = [(i, f"own line number {i * 7919} of this text\n\n{line}\n \t") for i, line in enumerate(lines)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "short"), (204, "short"), (205, "Short"), (206, long),
             (207, long[:-3] + "end"), (208, "a\r\nb"), (209, "b\nb")]
    df = spark.createDataFrame([(i, t, "m", 1, 2) for i, t in rows] + [(203, "short", "m", 1, 2)], DOCS)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows) + 1 and {(r["mark"], r["id"], r["key"]) for r in got} == {("m", 1, 2)}
    want = dict(zip((i for i, _ in rows), _line_brute(rows)))
    for r in got:
        assert r["text"] == want[r["doc_id"]], r["doc_id"]
    assert want[204] == "" and want[207] == "" and want[209] == "" or want[209].count("b") <= 1
    assert sum(r["doc_id"] == 203 and r["text"] == "short" for r in got) == 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "one line here\nother"), (1, "one line here")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(nulls).collect()} == {None: "one line here\nother", 1: ""}


def _hub_families(rng):
    """Lines each near its family's template or the line before, but mostly not near each other."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    lines = []
    for _ in range(12):  # one word of 21 changed
        hub = [word() for _ in range(21)]
        lines.append(" ".join(hub))
        for _ in range(40):
            own = list(hub)
            own[rng.randrange(21)] = word()
            lines.append(" ".join(own))
    for _ in range(8):  # chains
        own = [word() for _ in range(21)]
        for _ in range(15):
            own[rng.randrange(21)] = word()
            lines.append(" ".join(own))
    rng.shuffle(lines)
    return lines


def test_line_dedup_hub_families_and_chains(spark):
    rows = list(enumerate(_hub_families(random.Random(21))))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _line_brute(rows)
    assert all(got[i] != "" or t == "" for (i, _), t in zip(rows, want))
    assert sum(got[i] != t for (i, _), t in zip(rows, want)) <= 2  # signatures may miss a pair


def test_links_of_a_bucket_are_complete(spark):
    """All lines in one bucket, no pair let go before verification: the links are those of brute force."""
    lines = _hub_families(random.Random(22))[:200]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "lh long, line string")
    buckets = df.select(F.lit(1).cast("long").alias("bucket"), "lh")
    mins = df.select("lh", *[F.lit(0).alias(m) for m in line_dedup._MINS])
    labels = connected_components(line_dedup._links(buckets, df, mins)).collect()
    label = {r["node"]: r["label"] for r in labels}
    sets = [{x[i:i + 8] for i in range(len(x) - 7)} for x in lines]
    parent = list(range(len(lines)))
    for i, one in enumerate(sets):
        for j in range(i):
            if 100 * len(one & sets[j]) >= 80 * len(one | sets[j]):
                x, y = _find(parent, i), _find(parent, j)
                parent[max(x, y)] = min(x, y)
    assert {i: label.get(i, i) for i in range(len(lines))} == {i: _find(parent, i) for i in range(len(lines))}


def _near_pairs(rng, kind):
    """Pairs of lines of similarity 0.80 to 0.82 (or 1, of different lengths)."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    sets = lambda x: {x[i:i + 8] for i in range(max(1, len(x) - 7))}
    out = []
    while len(out) < 40:
        if kind == "repetitive":  # one phrase, 100 and 1,000 characters
            phrase = " ".join(word() for _ in range(3))
            one, two = (phrase * 60)[:100], (phrase * 60)[:1000]
        else:
            words = [word() for _ in range(8 if kind == "short" else 60)]
            one = " ".join(words)
            two = one[:len(one) - rng.randint(0, len(one) // 5)] + word()[:rng.randint(0, 6)]
        same = len(sets(one) & sets(two)) / len(sets(one) | sets(two))
        if 0.80 <= same <= 0.82 or same == 1:
            if one != two:
                out.append((one, two))
    return out


@pytest.mark.parametrize("kind", ["short", "sampled", "repetitive"])
def test_line_dedup_recall_near_the_limit(spark, kind):
    lines = [x for pair in _near_pairs(random.Random(31), kind) for x in pair]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    found = sum(got[i] == "" for i in range(1, len(lines), 2))
    assert found == 40 if kind == "repetitive" else found >= 38


# ---------------------------------------------------------------- n-gram join
def _sets(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(words[p:p + 3]) for p in range(max(1, len(words) - 2))} if words else set()


def _components(rows, percent=90):
    sets, parent, holders = [_sets(t) for _, t in rows], list(range(len(rows))), defaultdict(list)
    for k, own in enumerate(sets):
        shared = Counter(j for w in own for j in holders[w])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[_find(parent, k)] = _find(parent, j)
        for w in own:
            holders[w].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        root = _find(parent, k)
        least[root] = min(least.get(root, i), i)
    return sorted((i, len(sets[k]), least[_find(parent, k)]) for k, (i, _) in enumerate(rows))


def _family(rng, n, edits):
    """Texts near the limit of similarity, in chains."""
    words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 150))]
    for _ in range(n):
        words = list(words)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(5000)}"
        if rng.random() < 0.3:
            words += [f"t{rng.randrange(99)}"]
        yield " ".join(words)


@pytest.mark.parametrize("block_bytes", [8 << 20, 20_000])
def test_ngram_join_against_brute_force(spark, block_bytes):
    rng = random.Random(11)
    texts = [t for _ in range(40) for t in _family(rng, rng.randint(1, 14), 4)]
    big = [f"c{i}" for i in range(120)]
    for i in range(150):  # one large group of near copies
        own = list(big)
        own[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(own))
    texts += ["", "  \n", "one", "ONE", "one two", "one two three", "A b c d", "a B c d", "word " * 50_000, "word " * 40_000]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, "m", 1, 2) for i, t in rows], DOCS)
    out = signature_join.jaccard_components(df, block_bytes=block_bytes).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == _components(rows)


def test_ngram_join_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (5, "other words here"), (None, text), (2, "A B C D E F G H"), (7, None), (7, ""),
            (None, "lonely text of no id"), (9, None)]
    df = spark.createDataFrame([(i, t, "m", 1, 2) for i, t in rows], DOCS)
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in signature_join.jaccard_components(df).collect()),
                 key=str)
    assert out == sorted([(5, 6, 2), (5, 6, 2), (5, 1, 5), (None, 6, 2), (2, 6, 2), (7, 0, 7), (7, 0, 7), (None, 3, None),
                          (9, 0, 9)], key=str)
    kept = signature_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(5, "other words here"), (None, text), (2, "A B C D E F G H"), (7, None), (7, ""), (None, "lonely text of no id"),
         (9, None)], key=str)
    assert signature_join.jaccard_components(df.limit(0)).count() == 0
    assert signature_join.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_always_share_a_mark(percent):
    rng, linked = np.random.default_rng(5), 0
    marks = lambda x: set(signature_join.part_marks(x, percent).tolist())
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        for drop in range(0, n // 5 + 1, max(1, n // 25)):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2 ** 63, int(rng.integers(0, n // 10 + 1)), np.uint64)]))
            if len(b) and signature_join._linked(a, b, percent):
                linked += 1
                assert marks(a) & marks(b)
    assert linked > 300


@pytest.mark.parametrize("size,percent,most", [(3, 90, 100), (5, 80, 450)])
def test_marks_tell_texts_apart(size, percent, most):
    """No mark of an empty part: it would be common to sets that share nothing."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2 ** 63, int(rng.integers(1, 500)), dtype=np.uint64)) for _ in range(300)]
    marks = [signature_join.part_marks(s, percent) for s in sets]
    every = np.concatenate([np.unique(m) for m in marks])
    assert len(np.unique(every)) == len(every)
    assert len(every) / len(sets) < most


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    quality, lines, near, leaks, tokens = (f for _, f in corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    good = quality(spark, docs, MID)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert all(d in kept for d, q in labels.items() if q == 1)
    assert len([d for d, q in labels.items() if q == 0 and d in kept]) <= 0.2 * sum(q == 0 for q in labels.values())
    left = lines(spark, good, MID)
    assert left.columns == docs.columns and left.count() == len(kept)
    assert left.filter("n_chars <> length(text)").count() == 0
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    one = near(spark, left, MID)
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == {c for *_, c in _components(rows)}
    clean = leaks(spark, one, MID)
    assert clean.columns == docs.columns and 0 < clean.count() <= one.count()
    out = tokens(spark, clean, MID)
    assert out.count() == clean.count() and out.filter("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, MID).count() == out.count()


def _five_word_components(rows):
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[p:p + 5]) for p in range(max(1, len(words) - 4))})
    parent = list(range(len(rows)))
    for i, one in enumerate(sets):
        for j in range(i):
            if 100 * len(one & sets[j]) >= 80 * len(one | sets[j]):
                x, y = _find(parent, i), _find(parent, j)
                parent[max(x, y)] = min(x, y)
    return {_find(parent, k) for k in range(len(rows))}


def test_near_duplicates_stage_takes_five_words(spark):
    rng = random.Random(41)
    texts = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(300)]
        texts.append(" ".join(words))
        for at in rng.sample(range(5, 295, 12), g % 9):  # 6 words replaced: 0.816 of five words, 0.886 of three
            words[at] = f"g{g}x{at}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, MID).collect()}
    assert kept == _five_word_components(rows) and len(kept) < 100


def test_pipeline_stages_on_empty_and_odd_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, "en", "s", None), (None, "some text without id", None, None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality" and rows:
                continue  # its verdict on such texts is the classifier's
            docs = stage(spark, docs, SF)
            docs.collect()
        assert docs.count() == (0 if not rows else 3)
