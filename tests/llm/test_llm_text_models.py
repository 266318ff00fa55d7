"""LM scoring, quality classifier and BPE against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from pairlab.llm import bpe_rounds, lm_bloom, quality_gbt
from pairlab.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
LONG = "wort " * 60_000
ODD = [(1, "The the cat"), (1, "The the cat"), (2, None), (3, ""), (4, " \t\n"), (None, "a cat"), (5, LONG),
       (6, "caf\u00e9 \U0001F642 <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    ensure_checkpoint_dir(spark)
    rows = [(i, t, "x", 1.5, 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens double, key int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def _words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()) + [b"\0"]


def test_lm_query_against_exact_counts(spark):
    got = {r["doc_id"]: r for r in se.queries()["op1_lm_score"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = Counter()
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2:
            counts.update(_words(d["text"]))
    n, v = sum(counts.values()), len(counts)
    held, base = 0.0, 0.0
    for d in docs:
        words, r = _words(d["text"]), got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["train_tokens"]) == (len(words), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        assert r["score"] <= 0
        held, base = held + r["score"] * r["held_out"], base + want * r["held_out"]
    assert held > base  # neighbours help on texts not seen in training


def test_lm_score_is_the_smoothed_formula_with_exact_levels(spark, odd):
    train = odd.filter("doc_id <> 5")
    model = lm_bloom.train(train, prior=2.0)
    one, two = Counter(), Counter()
    for _, t in ODD:
        if t != LONG and t != "a cat":  # a null id fails the filter
            words = _words(t)
            one.update(words)
            two.update(zip([b"\0"] + words, words))
    n, v = sum(one.values()), len(one)
    assert (model.n_tokens, model.n_words) == (n, v)
    got = lm_bloom.score_texts(odd, model).collect()
    assert len(got) == len(ODD) and [r["doc_id"] for r in got].count(1) == 2
    level = lambda c: float(lm_bloom._level_counts()[lm_bloom._levels_of(c)]) if c else 0.0
    for doc_id, text in ODD:
        want, words = 0.0, _words(text)
        for a, b in zip([b"\0"] + words, words):
            p = (level(one[b]) + 1) / (n + v + 1)
            want += math.log10((min(level(two[a, b]), level(one[a])) + 2 * p) / (level(one[a]) + 2))
        row = next(r for r in got if r["doc_id"] == doc_id)
        assert row["score"] == pytest.approx(want, rel=0.02)  # a false positive may raise a count


def test_lm_segments_and_rare_words_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3))
    whole = lm_bloom.train(docs)
    cut = lm_bloom.train(docs, segment_bytes=5_000, head_words=500)
    assert len(whole.segments) == 1 and len(cut.segments) > 3 and cut.head_from > 1
    a = lm_bloom.score_texts(docs, whole).toPandas().sort_values(["doc_id"]).reset_index(drop=True)
    b = lm_bloom.score_texts(docs, cut).toPandas().sort_values(["doc_id"]).reset_index(drop=True)
    assert len(a) == len(b) == docs.count()
    assert (a["n_known"] == b["n_known"]).all()
    assert (a["base_score"] - b["base_score"]).abs().max() < 1e-8
    assert (a["score"] - b["score"]).abs().max() < 1e-8


def test_lm_empty_tables(odd, empty):
    assert lm_bloom.score_texts(empty, lm_bloom.train(odd)).count() == 0
    nothing = lm_bloom.score_texts(odd, lm_bloom.train(empty)).collect()
    assert len(nothing) == len(ODD) and all(r["score"] == 0 and r["n_known"] == 0 for r in nothing)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = se.queries()["op6_quality"](spark, sf).filter("held_out").join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) / len(good) > 0.99
    assert sum(1 - r["predicted"] for r in bad) / len(bad) > 0.97


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality_gbt.fit(odd, labels)
    scored = odd.withColumn("out", quality_gbt.quality_score(F.col("text"), model)).collect()
    assert len(scored) == len(ODD) and all(0 <= r["out"] <= 1 and r["score"] == "x" for r in scored)
    assert {r["out"] for r in scored if r["doc_id"] == 2} == {r["out"] for r in scored if r["doc_id"] == 3}
    for docs, lab in ((empty, labels), (odd, labels.limit(0)), (odd, labels.filter("quality = 0"))):
        model = quality_gbt.fit(docs, lab)
        assert odd.select(quality_gbt.quality_score(F.col("text"), model).alias("s")).filter(
            "s between 0 and 1").count() == len(ODD)
        assert empty.select(quality_gbt.quality_score(F.col("text"), model)).count() == 0


def test_quality_trees_flattened_score_equals_a_walk():
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 1] + 0.3 * x[:, 2] ** 2 > 0.4).astype(float)
    m = quality_gbt.train(x, y, trees=12, depth=3)
    for i in range(0, 400, 37):
        total = m.base
        for t in range(12):
            node = 0
            while node < 7:
                node = 2 * node + (2 if x[i, m.feature[t, node]] > m.threshold[t, node] else 1)
            total += m.value[t, node - 7]
        assert m.score(x[i:i + 1])[0] == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def _same_as_library(rows):
    lib = _library()
    for text, r in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        read = lib.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(read.encode()).hexdigest()


def test_bpe_query_equals_the_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = se.queries()["op9_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    _same_as_library((texts[r["doc_id"]], r) for r in rows)


def test_bpe_odd_texts(spark, odd, empty):
    extra = ["aaaaaaaa" * 50, "'s 'll don't", "<|endoftext|><|endoftext|>", "\u0000\x1c\x85\u00a0\u3000 x",
             "x" * 20_000, "  leading and trailing  \n\n"]
    more = spark.createDataFrame([(9, t, "x", 0.0, 0) for t in extra], odd.schema).unionByName(odd)
    rows = more.withColumn("d", bpe_rounds.bpe_digest(spark, F.col("text"))).select("text", "d.*").collect()
    assert len(rows) == len(extra) + len(ODD)
    _same_as_library((r["text"], r) for r in rows)
    back = more.withColumn("ids", bpe_rounds.bpe_encode(spark, F.col("text"))).withColumn(
        "read", bpe_rounds.bpe_decode(spark, F.col("ids"))).collect()
    assert all(r["read"] == (r["text"] or "") for r in back)
    assert empty.select(bpe_rounds.bpe_digest(spark, F.col("text"))).count() == 0


def _statistics_brute(text):
    """The features of one text, each from its definition."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality_gbt.FEATURES)
    share = lambda pattern: len(re.findall(pattern, raw)) / len(raw)
    words, lines = re.findall(rb"[^\x20\x09-\x0d]+", raw), re.split(rb"\n", raw)
    n = max(1, len(words))
    out = [share(p) for p in (rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[\x80-\xff]", rb"\n", rb"[.?]", rb"[,;:]", rb"!", rb"\|",
                              rb"['\"`]", rb"[()\[\]{}<>]", rb"[#$%&*+\-/=@\\^_~]")]
    most = max(Counter(words).values(), default=0)
    again = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values())
    return out + [
        math.log(1 + len(raw)), math.log(1 + len(words)), sum(map(len, words)) / n, len(set(words)) / n, most / n, again / n,
        math.log(1 + len(lines)), math.log(1 + len(raw) / len(lines)), math.log(1 + max(len(x) for x in lines)),
        len(set(lines)) / len(lines), entropy, math.log(1 + len(words) / max(1, len(re.findall(rb"[.?]", raw))))]


def test_document_statistics_against_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " \n\t", "a", "a a a", "\n\n", "\u00e9\U0001f600! |x|", "A.b?c,d;e:\x0bf\x0cg", "x" * 100_000]
    got = quality_gbt.document_statistics(texts)
    assert got.shape == (len(texts), len(quality_gbt.FEATURES))
    for row, text in zip(got, texts):
        assert row == pytest.approx(_statistics_brute(text), abs=1e-9)


def test_null_ids_in_the_queries(spark, tmp_path):
    """A null id has a null held_out; op1 learns from its text, op6 does not (a null id has no label)."""
    docs = [(i, f"some words of text {i}") for i in range(30)] + [(None, "unheard of")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    scored = {r["doc_id"]: r for r in se.queries()["op1_lm_score"](spark, str(tmp_path)).collect()}
    assert len(scored) == 31 and scored[None]["held_out"] is None and scored[None]["n_known"] == scored[None]["n_tokens"] == 3
    judged = {r["doc_id"]: r for r in se.queries()["op6_quality"](spark, str(tmp_path)).collect()}
    assert len(judged) == 31 and judged[None]["held_out"] is None and 0 <= judged[None]["score"] <= 1
