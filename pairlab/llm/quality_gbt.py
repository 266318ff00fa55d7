"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text come from its byte histogram, its words and its lines; nothing but the text is an
input. Training takes labelled rows (at most ``MAX_TRAIN_ROWS``, chosen by a hash of the id, so the choice does
not depend on partitions) and grows trees level by level from gradient histograms. Trained trees are complete
binary trees flattened into three arrays (feature, threshold, leaf value), and a batch of documents goes down
all trees with one numpy step per level.

Results for odd input:
* null text counts as empty; an empty text has all-zero statistics and gets the score of such a row;
* without usable labels every score is 0.5; with one class only, the scores are that class's smoothed rate;
* several labels of one id count as the lowest; null labels and ids are no labels;
* repeated rows each get their score, other columns pass through, an empty table stays empty;
* very long texts are read whole, one text at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import slices

#: Bound of the labelled sample that the classifier is fitted on.
MAX_TRAIN_ROWS = 20_000
#: Score from which a document is predicted to be of quality 1.
THRESHOLD = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GROUPS = {  # byte classes whose shares are features
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256),
    "newline": [10], "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "quote": b"'\"`", "bracket": b"()[]{}<>",
    "symbol": b"#$%&*+-/=@\\^_~",
}
FEATURES = [*_GROUPS, "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "repeated_next",
            "log_lines", "line_bytes", "longest_line", "distinct_lines", "byte_entropy", "words_a_stop"]


def document_statistics(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each text."""
    hist = np.zeros((len(texts), 256))
    own = np.zeros((len(texts), 9))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if not raw:
            continue
        hist[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = raw.split(), raw.split(b"\n")
        n = max(1, len(words))
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        again = sum(map(bytes.__eq__, words, words[1:]))
        own[i] = (len(words), len(counts) / n, max(counts.values(), default=0) / n, again / n, len(lines),
                  len(raw) / len(lines), max(map(len, lines)), len(set(lines)) / len(lines), len(raw))
    size = np.maximum(hist.sum(axis=1), 1)
    share = [hist[:, list(g)].sum(axis=1) / size for g in _GROUPS.values()]
    p = hist / size[:, None]
    entropy = -np.sum(p * np.log2(np.where(p > 0, p, 1)), axis=1)
    words = np.maximum(own[:, 0], 1)
    solid = hist[:, ~_SPACE].sum(axis=1)
    stops = hist[:, list(_GROUPS["stop"])].sum(axis=1)
    rest = [np.log1p(own[:, 8]), np.log1p(own[:, 0]), solid / words, own[:, 1], own[:, 2], own[:, 3],
            np.log1p(own[:, 4]), np.log1p(own[:, 5]), np.log1p(own[:, 6]), own[:, 7], entropy,
            np.log1p(own[:, 0] / np.maximum(stops, 1))]
    return np.column_stack(share + rest)


@dataclass
class FlatTrees:
    """Complete trees of one depth, node k's children at 2k+1 and 2k+2."""

    base: float
    depth: int
    feature: np.ndarray    # trees x (2^depth - 1)
    threshold: np.ndarray  # trees x (2^depth - 1)
    value: np.ndarray      # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        leaf = at - (2 ** self.depth - 1)
        return 1 / (1 + np.exp(-(self.base + self.value[trees, leaf].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
          ridge: float = 1.0, least: float = 2.0) -> FlatTrees:
    """Logistic boosting. ``least``: smallest sum of second derivatives in a child."""
    nodes, n_features = 2 ** depth - 1, x.shape[1]
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    out = FlatTrees(base, depth, np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf),
                    np.zeros((trees, nodes + 1)))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-9)
            for f in range(n_features):
                cell = (at - first) * bins + binned[:, f]
                gs = np.cumsum(np.bincount(cell, g, width * bins).reshape(width, bins), axis=1)
                hs = np.cumsum(np.bincount(cell, h, width * bins).reshape(width, bins), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(edges[f]):] = 0
                cut = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), cut] > best):
                    best[k] = gain[k, cut[k]]
                    out.feature[t, first + k], out.threshold[t, first + k] = f, edges[f][cut[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), out.feature[t, at]] > out.threshold[t, at])
        leaf = at - nodes
        gs, hs = np.bincount(leaf, g, nodes + 1), np.bincount(leaf, h, nodes + 1)
        out.value[t] = rate * gs / (hs + ridge)
        margin += out.value[t][leaf]
    return out


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([row for a, b in slices(texts) for row in
                         document_statistics(texts.slice(a, b - a).to_pylist())], pa.list_(pa.float64()))
    return stats(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS,
        keep: Column | None = None) -> FlatTrees:
    """Fit on the labelled rows of ``docs``. ``keep``: condition on doc_id of rows whose labels may be seen.
    The sample's ids are chosen on the label table alone; only its texts are read for statistics."""
    seen = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    seen = seen.filter(keep) if keep is not None else seen
    sample = (seen.groupBy("doc_id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select("doc_id", "y", statistics_column(F.col("text")).alias("x"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).select("y", "x").collect())
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return train(x, np.array([float(r["y"] > 0) for r in rows]))


def quality_score(text: Column, model: FlatTrees) -> Column:
    """Probability that the text is of quality 1; no shuffle, one pass."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [model.score(document_statistics(texts.slice(a, b - a).to_pylist())) for a, b in slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))
    return score(F.coalesce(text, F.lit("")))
