"""Conversation trie, periodic runs and substring dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import conversation_trie, debruijn, periodic_runs, queries
from pairlab.llm.tokens import mix
from pairlab.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string, conv int, pos int, a string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def _shared(spark):
    ensure_checkpoint_dir(spark)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- conversations
def _trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in by.items()}
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    size = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        size[c] = len(path)
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    for k in sorted(nodes, key=len, reverse=True):
        if k:
            kids[k[:-1]].append(k)
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                   _sha(",".join(str(c) for c in sorted(m) if size[c] == len(k)))) for k, m in nodes.items())


def _built(rows, **sizes):
    turns = conversation_trie.numbered_turns(rows)
    length = F.crc32(F.col("conv").cast("string")) % 9
    grafted = conversation_trie.graft(turns, F.col("conv") - F.col("conv") % 5, length)
    return sorted(tuple(r) for r in conversation_trie.prefix_trie(*grafted, **sizes).collect())


def _conversations(seed):
    rng, rows = random.Random(seed), []
    for c in range(-20, 50):
        if rng.random() < 0.2:
            continue
        for t in range(rng.randrange(1, 13)):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", "", None]),
                         rng.choice(["a", "b", "", None, "é"])))
    return rows + [(None, 1, "user", "no conversation")] + [rows[3]] * 2


@pytest.mark.parametrize("sizes", [{}, {"shard_turns": 40}, {"shard_turns": 8, "sent_nodes": 0}])
def test_trie_equals_brute_force(spark, sizes):
    """Nulls, ties, repeated rows, clashing columns; one shard, several, and a top added up level by level."""
    rows = _conversations(1)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS)
    assert _built(df, **sizes) == _trie(rows)


def test_trie_of_long_and_of_no_conversations(spark):
    rows = [(5, i, "u", f"t{i % 3}") for i in range(2500)] + [(10, i, "u", f"t{i % 3}") for i in range(1500)]
    short = "conv_id long, turn long, role string, text string"
    assert _built(spark.createDataFrame(rows, short)) == _trie(rows)
    assert _built(spark.createDataFrame([], short)) == []


def test_trie_starts_again_when_two_prefixes_have_one_digest(spark, monkeypatch):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "b"), (3, 0, "u", "a")]
    df = spark.createDataFrame(rows, "conv long, pos long, role string, text string")
    real, salts = conversation_trie._occurrences, []

    def clash(turns, convs, salt):
        salts.append(salt)
        out = real(turns, convs, salt)
        return out.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(7).cast("long")}) if salt == 0 else out
    monkeypatch.setattr(conversation_trie, "_occurrences", clash)
    got = conversation_trie.prefix_trie(df, df.select("conv").distinct())
    assert sorted(r["n_convs"] for r in got.collect()) == [1, 2, 3] and salts == [0, 1]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 64, (2, 5000), np.uint64)
    keys[0, :100], keys[1, 100:200] = 0, 0
    table = conversation_trie.PerfectHash(*keys)
    assert sorted(table.slots(*keys).tolist()) == list(range(5000))
    assert (table.slots(keys[0], keys[1] + np.uint64(1)) == -1).all()
    none = conversation_trie.PerfectHash(*keys[:, :0])
    assert none.slots(*keys[:, :2]).tolist() == [-1, -1]


# ---------------------------------------------------------------- runs
def _runs(w):
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in out.items())


def _repetitive(rng):
    n, k = rng.choice([0, 5, 24, 100, 400, 900]), rng.choice([1, 2, 3, 10, 1000])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 30 else 0):
        a, p = rng.randrange(n), rng.randint(1, n // 4)
        unit = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(p)]
        if p > 5 and rng.random() < 0.5:  # a short period within the long one
            r = rng.randint(1, 3)
            for i in range(rng.randint(0, p - 1)):
                unit[i] = unit[i % r]
        for i in range(a, min(n, a + rng.randint(3 * p, 6 * p))):
            w[i] = unit[(i - a) % p]
    return w


def test_runs_equal_a_scan_of_all_lags():
    rng = random.Random(3)
    for _ in range(150):
        docs = [_repetitive(rng) for _ in range(rng.randint(1, 5))]
        first = np.cumsum([0] + [len(d) for d in docs])
        keys = mix(np.array([x + 1 for d in docs for x in d], np.uint64))
        assert periodic_runs.find_runs(keys, first) == sorted((t, *r) for t, d in enumerate(docs) for r in _runs(d))


def test_runs_of_very_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a  # a Fibonacci word has runs at every scale
    assert [r[1:] for r in periodic_runs.find_runs(mix(np.array(b, np.uint64)), np.array([0, len(b)]))] == _runs(b)
    long = np.arange(400_000, dtype=np.uint64) % np.uint64(99_991)
    assert periodic_runs.find_runs(mix(long), np.array([0, len(long)])) == [(0, 0, 400_000, 99_991)]


def _op12(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _runs(w)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            _sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), _sha(kept))


def test_op12_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{x}" for x in _repetitive(rng)[:400])) for i in range(-30, 120)]
    rows += [(None, "a b " * 20), (None, None), (500, None), (501, ""), (502, " \t\n"), (503, "É x y\x0bZ " * 12),
             rows[5], rows[5]]
    rows += [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
             if len(r["text"]) < 4000]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", runs int, collapsed string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((_op12(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 50
    assert queries.op12_periodic_runs(spark, str(tmp_path)).filter("false").count() == 0


# ---------------------------------------------------------------- repeated windows
def _cut(rows, width=13):
    words = [WORD.findall(x or "") for _, x in rows]
    least, out = {}, []
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[p:p + width])
            least[key] = min(i, least.get(key, i))
    for (i, _), w in zip(rows, words):
        gone = {q for p in range(len(w) - width + 1 if i is not None else 0) if least[tuple(w[p:p + width])] < i
                for q in range(p, p + width)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def _passages(seed):
    rng = random.Random(seed)
    known = [[f"p{j}w{rng.randrange(40)}" for _ in range(rng.randint(10, 60))] for j in range(12)]
    rows = [(None, "a b " * 20), (None, None), (3, None), (3, ""), (5, "x " * 50), (6, "x " * 20), (6, "x " * 20),
            (6, " ".join(known[0])), (7, "A " * 14), (8, "a " * 14), (-(2**62), " ".join(known[1]))]
    for _ in range(100):
        w = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(known)
            a = rng.randrange(len(part))
            w += part[a:a + rng.randint(5, 50)] if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(9)]
        rows.append((rng.randrange(-50, 200), " ".join(w)))
    return rows + rows[10:14]


@pytest.mark.parametrize("sizes", [{}, {"bucket_windows": 300, "slice_bytes": 1000}])
def test_repeats_equal_brute_force(spark, sizes):
    """Null and repeated ids, rows and texts, odd texts, clashing columns; one bucket and slice, and many."""
    rows = _passages(5)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCS + ", cut int, mark int, spans string").repartition(4)
    got = debruijn.remove_repeats(df, **sizes)
    assert got.columns[:5] == df.columns
    got = got.select("doc_id", F.expr("_cut.n_words"), F.expr("_cut.n_removed"), F.expr("_cut.kept"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _cut(rows)


def test_repeats_of_no_documents(spark):
    assert debruijn.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_paths_are_cut_where_documents_leave_and_enter(spark):
    part = {c: [f"{c}{i}" for i in range(30)] for c in "abcd"}
    text = lambda names: " ".join(w for c in names for w in part[c])
    rows = [(1, text("abc")), (2, text("abc")), (3, text("abd")), (4, text("abd"))]
    spans = debruijn.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    own = {i: sorted((r["start"], r["n"], r["path"]) for r in spans if r["id"] == i) for i in (2, 3, 4)}
    # windows 0 ... 47 are a b in all; from 48 on, the next word is of c or d
    assert [x[:2] for x in own[2]] == [(0, 48), (48, 30)] and [x[:2] for x in own[3]] == [(0, 48)]
    assert [x[:2] for x in own[4]] == [(0, 48), (48, 30)]
    assert len({own[2][0][2], own[3][0][2], own[4][0][2]}) == 1
    assert len({own[2][1][2], own[4][1][2], own[2][0][2]}) == 3


def test_a_path_goes_on_where_its_source_ends(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:40])), (2, " ".join(w[20:])), (3, " ".join(w)), (4, " ".join(w))]
    spans = debruijn.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    assert len({r["path"] for r in spans if r["id"] == 4}) == 1
    assert sum(r["n"] for r in spans if r["id"] == 4) == 48


def test_windows_with_one_key_are_told_apart(spark, monkeypatch):
    """A window is named by another one at first, which differs: other keys are taken."""
    salts = []

    def named(docs, width, bucket_windows, slice_bytes, salt):
        salts.append(salt)
        found = real_named(docs, width, bucket_windows, slice_bytes, salt)
        if salt:
            return found
        first = found.filter("n = 0").orderBy("id").limit(1).select(F.col("base").alias("b"), F.col("at").alias("s"))
        wrong = found.filter("n = 0 and id = 2").crossJoin(first).select(
            "id", "mark", "words", "start", "base", "at", F.lit(1).cast("long").alias("n"),
            F.col("b").alias("source_base"), F.col("s").alias("source"))
        return found.unionByName(wrong)
    real_named = debruijn._named_windows
    monkeypatch.setattr(debruijn, "_named_windows", named)
    rows = [(1, " ".join(f"a{i}" for i in range(20))), (2, " ".join(f"b{i}" for i in range(20)))]
    out = debruijn.remove_repeats(spark.createDataFrame(rows, DOCS))
    assert [r["cut"]["n_removed"] for r in out.collect()] == [0, 0] and salts == [0, 2]


def test_repeats_are_joined_alike_at_any_size(spark, monkeypatch):
    """Texts meet their spans by a shuffle also in a small table; only texts to verify are shuffled for that, or all."""
    from pairlab.llm import debruijn
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 40:i % 40 + 13] + [f"x{i}"] * (i % 3) + words[:14 * (i % 2)])) for i in range(90)]
    docs = spark.createDataFrame(rows + [(None, " ".join(words)), (3, None)], "doc_id long, text string")
    out = debruijn.remove_repeats(docs)
    first = sorted(map(str, out.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin.*LeftOuter", plan) and not re.search(r"BroadcastHashJoin.*LeftOuter", plan)
    monkeypatch.setattr(debruijn, "SENT_IDS", 0)
    assert sorted(map(str, debruijn.remove_repeats(docs).collect())) == first


def test_shuffle_files_of_a_written_table_go(spark):
    import time

    from pairlab.llm.common import written
    env = spark._jvm.org.apache.spark.SparkEnv
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data",
                                   env.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")))
    before = files()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, None)
    table = written(spark.range(10_000).repartition(5).selectExpr("id % 7 as k").groupBy("k").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and table.count() == 7 and spark.conf.get(name, None) == had
