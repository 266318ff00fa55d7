"""URL filter over a sorted digest array.

Rules are strings ``host + path prefix`` (``example.net/en/``), each with a verdict. They are kept as shards of
a bounded number of rules. A shard is three flat files: the 64-bit xxhash keys in ascending order, the rule
strings in the same order, and their offsets. The files reach the executors with ``SparkContext.addFile`` and
are memory-mapped by the Python workers, so a worker holds pages in use and not the list.

For each url the candidates are host suffix x path prefix, at the prefix lengths that rules have. Their keys
are probed with one vectorised binary search per shard and batch, and each key found is confirmed against the
stored string, so two strings with one digest are told apart. The longest rule that fits wins.

Results for odd input:
* null url or one without ``://``: empty host and path, no rule, the default verdict;
* an empty table gives an empty table, an empty rule list gives the default verdict throughout;
* repeated rows each get a row; other columns pass through and never clash with the result's column;
* a rule given twice with both verdicts blocks.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict of a url that no rule fits.
DEFAULT_VERDICT = "allow"
#: Rules held by one shard; a rule table of any size becomes several shards.
SHARD_RULES = 4_000_000

_UPPER = {c: c + 32 for c in range(65, 91)}
_RESULT = "host string, path string, rule string, verdict string"


def _digests(strings: Iterable[str]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(s.encode()) for s in strings), dtype=np.uint64)


class DigestIndex:
    """Names of the shard files known to the executors, and the path lengths that rules have."""

    def __init__(self, shards: list[tuple[str, int]], lengths: list[int]):
        self.shards, self.lengths = shards, lengths

    @staticmethod
    def build(spark: SparkSession, rules: Iterable[tuple[str, str]] | DataFrame,
              shard_rules: int = SHARD_RULES) -> DigestIndex:
        """``rules``: (rule, verdict) pairs, or a DataFrame with these two columns. A DataFrame is read
        shard by shard; the driver never holds more than one shard."""
        rows = ((r["rule"], r["verdict"]) for r in rules.toLocalIterator()) if isinstance(rules, DataFrame) else rules
        folder, shards, lengths, part = tempfile.mkdtemp(prefix="url-digests-"), [], set(), {}

        def flush() -> None:
            if not part:
                return
            strings = np.array(list(part), dtype=object)
            keys = _digests(strings)
            order = np.argsort(keys, kind="stable")
            raw = [(part[s] + s).encode() for s in strings[order]]
            name = f"urls-{uuid.uuid4().hex}"
            files = {"keys": keys[order].astype("<u8"), "text": np.frombuffer(b"".join(raw), np.uint8),
                     "ends": np.cumsum([len(x) for x in raw]).astype("<u8")}
            for kind, data in files.items():
                path = os.path.join(folder, f"{name}.{kind}")
                data.tofile(path)
                spark.sparkContext.addFile(path)
            shards.append((name, len(keys)))
            part.clear()

        for rule, verdict in rows:
            if rule is None or "/" not in rule:
                raise ValueError(f"a rule is host + path, such as example.net/: {rule!r}")
            if verdict not in ("allow", "block"):
                raise ValueError(f"a verdict is allow or block: {verdict!r}")
            host, slash, path = rule.partition("/")
            rule = host.translate(_UPPER) + slash + path
            lengths.add(len(path) + 1)
            part[rule] = "block" if part.get(rule) == "block" else verdict
            if len(part) >= shard_rules:
                flush()
        flush()
        return DigestIndex(shards, sorted(lengths))

    def open(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = lambda name, kind, t: np.memmap(SparkFiles.get(f"{name}.{kind}"), dtype=t, mode="r")
        return [(at(name, "keys", "<u8"), at(name, "ends", "<u8"), at(name, "text", np.uint8))
                for name, _ in self.shards]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (start := url.find("://")) < 0:
        return "", ""
    rest = url[start + 3:]
    stop = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, stop)
    host, path = (rest[:stop], "") if slash < 0 else (rest[:slash], rest[slash:stop])
    return host.translate(_UPPER), path


def _candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    parts = host.split(".")
    tails = [".".join(parts[i:]) for i in range(len(parts))] if host else []
    heads = [path[:n] for n in lengths if n <= len(path)]
    return [t + h for t in tails if t for h in heads]


def _judge(urls: pd.Series, index: DigestIndex, shards) -> pd.DataFrame:
    parsed = [split_url(u) for u in urls]
    texts, owners = [], []
    for i, (host, path) in enumerate(parsed):
        found = _candidates(host, path, index.lengths)
        texts += found
        owners += [i] * len(found)
    best: dict[int, str] = {}
    verdicts: dict[str, str] = {}
    if texts:
        probes = _digests(texts)
        for keys, ends, data in shards:
            at = np.searchsorted(keys, probes)
            for j in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == probes):
                k, text = int(at[j]), texts[j]
                while k < len(keys) and keys[k] == probes[j]:  # all strings with this digest
                    stored = data[int(ends[k - 1]) if k else 0:int(ends[k])].tobytes().decode()
                    if stored[5:] == text:
                        verdicts[text] = "block" if "block" in (stored[:5], verdicts.get(text)) else "allow"
                        if len(text) > len(best.get(owners[j], "")):
                            best[owners[j]] = text
                        break
                    k += 1
    rules = [best.get(i) for i in range(len(parsed))]
    return pd.DataFrame({"host": [h for h, _ in parsed], "path": [p for _, p in parsed], "rule": rules,
                         "verdict": [verdicts[r] if r else DEFAULT_VERDICT for r in rules]})


def url_verdict(url: Column, index: DigestIndex) -> Column:
    """Column of struct(host, path, rule, verdict); no shuffle, one pass over the urls."""
    @F.pandas_udf(_RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shards = index.open()
        for urls in batches:
            yield _judge(urls, index, shards)
    return judge(url)
