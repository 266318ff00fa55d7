"""Chat formatting, decontamination, url rules and secret scans: odd rows and hostile texts."""

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlab.llm import chat_grammar, decontaminate, secret_trigrams, url_digests
from pairlab.session import ensure_checkpoint_dir

PIECES = ["[INST] ", " [/INST]", "<<SYS>> ", " <</SYS>>", " </s>", "<s>", "[ROLE] ", " [TEXT] ", " [/ROLE]", "\\",
          "[\\INST]", "<\\\\/s>", "<", "[", "/", "ok", " ", "\n", "$1", "\u00e9", "\U0001F642"]


@pytest.fixture(scope="module", autouse=True)
def _shared(spark):
    ensure_checkpoint_dir(spark)


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 4)):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))
            role = rng.choice(["user", "assistant", "system", "tool", "[ROLE] x", ""])
            rows.append((conv, turn, role, text, "clash"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_grammar.format_conversations(df).collect()
    assert len(out) == 300
    by = {k: list(g) for k, g in itertools.groupby(rows, key=lambda r: r[0])}
    strip = re.compile(chat_grammar.UNESCAPE)
    for r in out:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in by[r["conv_id"]]]
        masked = "".join(strip.sub(r"\1\2\3", r["formatted"][s["start"]:s["end"]]) for s in r["loss_spans"])
        assert masked == "".join(x[3] for x in by[r["conv_id"]] if x[2] == "assistant")
    plain = next(r for r in out if all("[" not in x[3] and "<" not in x[3] and "\\" not in x[3]
                                       for x in by[r["conv_id"]]) and by[r["conv_id"]][0][2] == "user")
    assert plain["formatted"].startswith("<s>[INST] " + by[plain["conv_id"]][0][3] + " [/INST]")


def test_chat_nulls_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "assistant", "y" * 300_000),
            (2, 1, "assistant", "b"), (2, 1, "assistant", "a")]
    out = {r["conv_id"]: r for r in chat_grammar.digests(chat_grammar.format_conversations(
        spark.createDataFrame(rows, schema))).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 3, None: 1, 2: 2}
    assert out[None]["loss_chars"] == 300_000 and out[2]["loss_chars"] == 2
    turns = {r["conv_id"]: r["turns"] for r in chat_grammar.format_conversations(
        spark.createDataFrame(rows, schema)).collect()}
    assert [t["text"] for t in turns[2]] == ["a", "b"] and [t["text"] for t in turns[1]] == ["x", "", ""]
    assert chat_grammar.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_chat_loss_is_read_through_the_mask(spark):
    """Also where texts start with a byte order mark, or hold characters beyond the BMP or control strings."""
    texts = ["\ufeffa", "\U0001f600 b", "", "</s>[INST] ok [/INST]", "\ufeff", "\\[\\INST]"]
    rows = [(1, 2 * i + k, role, t) for i, t in enumerate(texts) for k, role in enumerate(["user", "assistant"])]
    out = chat_grammar.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = "".join(texts)
    (got,) = chat_grammar.digests(out).collect()
    assert (got["loss_chars"], got["loss_sha256"]) == (len(whole), hashlib.sha256(whole.encode()).hexdigest())
    wrong = out.withColumn("loss_spans", F.slice("loss_spans", 1, 2))  # a wrong mask shows in the digest
    assert chat_grammar.digests(wrong).first()["loss_chars"] == 5


def _words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _contamination(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = _words(t)
        if i is not None and w:
            n = min(width, len(w))
            for p in range(len(w) - n + 1):
                wins.setdefault(tuple(w[p:p + n]), set()).add(str(i))
    for d, t in docs:
        w, hit, found = _words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[p:p + n])):
                    hit |= set(range(p, p + n))
                    found |= ids
        yield d, len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force_and_in_blocks(spark):
    rng = random.Random(9)
    words = ["The", "cat", "caf\u00e9", "x1", "of", "a", "zz"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "!", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(40)]
    items += [(100, None), (None, text(12)), (101, ""), (102, "..."), (7, items[3][1]), (8, items[3][1])]
    docs = [(d, text(rng.choice([0, 1, 5, 30, 200]))) for d in range(60)] + [(60, None), (61, ""), (0, text(4))]
    docs.append((62, text(50) + " " + items[39][1].upper() + " " + text(40_000)))
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, hits string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((a, *r) for a, *r in _contamination(docs, items))
    for size in (200_000, 40):
        blocks = decontaminate.benchmark_blocks(d, b, block_words=size)
        assert (len(blocks) > 1) == (size == 40)
        out = d.select("doc_id", "hits", decontaminate.contamination(F.col("text"), blocks).alias("c"))
        out = out.select("doc_id", "hits", "c.n_words", decontaminate.summary(F.col("c.hits")).alias("s")).collect()
        assert {r["hits"] for r in out} == {"c"}
        assert sorted((r["doc_id"], r["n_words"], r["s"]["n_hit"], r["s"]["items"]) for r in out) == want
    none = decontaminate.benchmark_blocks(d, b.limit(0))
    assert d.select(decontaminate.contamination(F.col("text"), none).alias("c")).filter("size(c.hits) > 0").count() == 0
    assert d.limit(0).select(decontaminate.contamination(F.col("text"), blocks)).count() == 0


def test_url_rules_on_odd_urls(spark):
    rules = [("net/", "block"), ("Example.net/en/", "allow"), ("example.net/en/x", "block"), ("a.b/", "allow"),
             ("a.b/", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/", "http://x.example.net/en/xy?z#q",
            "http://net", "http://net/", "http://notexample.net/en/", "http://q?a=://u/", "http://a.b/c", "x://a://b/c",
            "http://x.net./", "http://..net//", "http://sub.example.net/EN/", "http://example.net/en/" + "y" * 100_000]
    want = ["", "", "", "", "example.net/en/", "example.net/en/x", "", "net/", "net/", "", "a.b/", "", "", "net/", "net/",
            "example.net/en/"]
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)] * 2,
                               "page_id int, url string, rule string, verdict string")
    for shard in (100, 1):
        index = url_digests.DigestIndex.build(spark, rules, shard_rules=shard)
        rows = df.withColumn("out", url_digests.url_verdict(F.col("url"), index)).collect()
        assert len(rows) == 2 * len(urls)
        for r in rows:
            assert (r["out"]["rule"] or "") == want[r["page_id"]], r
            expected = "block" if want[r["page_id"]] in ("net/", "example.net/en/x", "a.b/") else "allow"
            assert r["out"]["verdict"] == expected and r["rule"] == "r"
    table = spark.createDataFrame(rules, "rule string, verdict string")
    assert url_digests.DigestIndex.build(spark, table).lengths == index.lengths
    nothing = url_digests.DigestIndex.build(spark, [])
    assert df.select(url_digests.url_verdict(F.col("url"), nothing)["verdict"].alias("v")).distinct().collect()[0][0] == "allow"
    assert df.limit(0).select(url_digests.url_verdict(F.col("url"), index)).count() == 0


def test_url_digest_collisions_are_told_apart(monkeypatch):
    """With one digest for all strings only the stored strings decide."""
    import numpy as np
    import pandas as pd
    monkeypatch.setattr(url_digests, "_digests", lambda s: np.zeros(len(list(s)), np.uint64))
    raw = [b"blocknet/", b"allowexample.net/en/"]
    shard = (np.zeros(2, np.uint64), np.cumsum([len(x) for x in raw]), np.frombuffer(b"".join(raw), np.uint8))
    index = url_digests.DigestIndex([("x", 2)], [1, 4])
    out = url_digests._judge(pd.Series(["http://example.net/en/", "http://u.net/", "http://u.org/"]), index, [shard])
    assert out["rule"].tolist()[:2] == ["example.net/en/", "net/"] and out["rule"][2] is None


def _spans(text):
    out = []
    for rank, rule in enumerate(secret_trigrams.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_secrets_against_re(spark):
    rng = random.Random(2)
    parts = ["password", "PassWD", "api_key", "apikey", "token", "secret", " ", "=", ":", "'", '"', "AKIA", "ABCD1234EFGH5678",
             "deadbeefdeadbeefdeadbeef", "0f", "\u00e9", "\U0001F642", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----",
             "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "abc", "\n", "token:token:abcdef"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), "s") for i in range(400)]
    rows += [(400, None, "s"), (401, "", "s"), (0, rows[0][1], "s"), (0, "token=other1", "s"), (None, "secret: hunter22", "s"),
             (402, "x" * 200_000 + " password = hunter22 " + "token=abcdef " * 2000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = secret_trigrams.digests(df).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(((r["doc_id"], r["spans"]) for r in out), key=key) == sorted(((d, _spans(t)) for d, t, _ in rows), key=key)
    assert secret_trigrams.digests(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_trigram_queries_never_miss_a_match(data):
    pattern = data.draw(st.sampled_from([r.pattern for r in secret_trigrams.RULES] + [
        "ab?cde|xyz+", "(foo|ba)r{2,3}baz", "[ab]cd[ef]", "x*y", "(?:abc|d)(?:efg)?hij"]))
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True)).lower()
    clauses = secret_trigrams.trigram_query(pattern)
    assert not clauses or any(all(t in text for t in c) for c in clauses)
