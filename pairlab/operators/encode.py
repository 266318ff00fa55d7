"""Text -> vector path.

P1, the encoder, is a plug-in point; the built-in one hashes code-point
trigrams of the whole text into ``dim`` signed buckets and normalises the
count vector (feature hashing). It runs in an iterator ``arrow_udf``: the
trigrams of many texts are hashed and counted together, with one bincount for
up to ``BATCH_CHARS`` characters (or one longer text). It is applied to each
*distinct* text once, then joined back, so repeated texts cost nothing extra.

P2, mean pooling, averages token vectors over a document's tokens. The most
frequent tokens (a bounded broadcast of vectors, chosen by their number of
occurrences) are added up batch by batch where the texts lie; only the others
are counted per (document, token) and joined to the token-vector table, and
both are averaged in order of the key, weighted by the counts. Tokens without
a vector are dropped; a document with none gets the zero vector.

P3, truncation to ``max_tokens`` (the reference's ``max_seq_length``), is an
explicit option; by default whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..session import materialize

# Fixed values of the built-in encoder: trigram hash multipliers and default width.
TRI_A, TRI_B, TRI_C = 1000003, 10007, 101
DEFAULT_DIM = 256
#: Characters and rows that are encoded together.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 4096
TOKEN_PATTERN = r"\s+"
#: Occurrences from which a token may be sent, bytes of vectors that are sent (of the most frequent tokens), and occurrences
#: that are added up together.
HOT_DOCS, HOT_BYTES, HOT_STEP = 2, 64 << 20, 1 << 15


def trigram_vector(text: str | None, dim: int = DEFAULT_DIM) -> np.ndarray:
    """Unit-norm signed trigram-count vector of a text (zero if < 3 characters)."""
    v = np.zeros(dim, dtype=np.float64)
    if not text or len(text) < 3:
        return v
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    h = cp[:-2] * TRI_A + cp[1:-1] * TRI_B + cp[2:] * TRI_C
    idx = h % dim
    sign = 1.0 - 2.0 * ((h // dim) % 2)
    v = np.bincount(idx, weights=sign, minlength=dim).astype(np.float64)
    n = np.sqrt((v * v).sum())
    return v / n if n > 0 else v


def trigram_matrix(texts: pa.Array, dim: int = DEFAULT_DIM) -> np.ndarray:
    """``trigram_vector`` of each text of a batch, as rows."""
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[ends[0]:ends[-1]] if ends[-1] > ends[0] else b""
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    whole = row[:-2] == row[2:]  # trigrams that lie in one text
    h = (cp[:-2] * TRI_A + cp[1:-1] * TRI_B + cp[2:] * TRI_C)[whole]
    sign = 1.0 - 2.0 * ((h // dim) % 2)
    at = row[:-2][whole] * dim + h % dim
    m = np.bincount(at, weights=sign, minlength=len(texts) * dim).astype(np.float64).reshape(len(texts), dim)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=m, where=n > 0)


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of a batch with a bounded number of rows and characters; a text that is longer is a part."""
    total = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = int(np.searchsorted(total, done + BATCH_CHARS, side="right"))
        stop = min(max(stop, start + 1), start + BATCH_ROWS, len(texts))
        yield texts.slice(start, stop - start)
        start, done = stop, int(total[stop - 1])


def trigram_encoder(dim: int = DEFAULT_DIM):
    """P1 as a Spark expression factory: ``encoder(col) -> array<double>``."""
    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [trigram_matrix(part, dim) for part in _pieces(texts)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            starts = np.arange(len(texts) + 1, dtype=np.int32) * dim
            yield pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
    return encode


def encode_distinct(df: DataFrame, text_col: str, encoder=None, out: str = "embedding") -> DataFrame:
    """Encode each distinct text once and join the vectors back."""
    enc = encoder or trigram_encoder()
    distinct = df.select(F.col(text_col).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    vec = distinct.select("_t", enc(F.col("_t")).alias(out))
    return df.join(vec.withColumnRenamed("_t", text_col), text_col, "left")


def tokens(text: Column, max_tokens: int | None = None) -> Column:
    """Whitespace tokens without empties; P3 keeps the first ``max_tokens``."""
    t = F.array_remove(F.split(text, TOKEN_PATTERN), "")
    return F.slice(t, 1, int(max_tokens)) if max_tokens else t


def mean_pool(docs: DataFrame, key: str, text_col: str, token_vectors: DataFrame,
              max_tokens: int | None = None) -> DataFrame:
    """``key, n_tokens, embedding`` = mean of the token vectors.

    ``token_vectors``: ``token string, embedding array<double>``; a column ``n``, if there is one, says how often a token
    occurs, else the tokens are counted."""
    counted = "n" in token_vectors.columns
    vectors = materialize(token_vectors.select("token", "embedding", *["n"] * counted))
    dim = int(vectors.select(F.max(F.size("embedding")).alias("d")).first()["d"] or 0)
    listed = docs.select(key, tokens(F.col(text_col), max_tokens).alias("tokens"))
    # the most frequent tokens are added up where the texts lie; the others, with fewer occurrences, are joined by token
    often = vectors.groupBy("token").agg(F.max("n").alias("n")) if counted else listed.select(
        F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    often = often.filter(F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "token").limit(HOT_BYTES // (8 * max(dim, 1)))
    sent = (vectors.join(F.broadcast(often.select("token")), "token").select("token", array_to_vector("embedding").alias("v"))
            .groupBy("token").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("total"), F.count(F.lit(1)).alias("n")))
    sent = sent.toArrow().combine_chunks()
    matrix = pc.list_flatten(sent.column("total")).to_numpy().reshape(-1, max(dim, 1))
    hot = docs.sparkSession.sparkContext.broadcast((sent.column("token").to_pylist(), matrix, sent.column("n").to_numpy()))
    names = StructType([docs.select(key).schema[0], StructField("n", LongType()), StructField(
        "mean", ArrayType(DoubleType())), StructField("rest", ArrayType(StringType()))])
    pooled = materialize(listed.mapInArrow(_hot_means(hot), names))
    rest = pooled.select(key, F.explode("rest").alias("token")).groupBy(key, "token").agg(
        F.count(F.lit(1)).cast("double").alias("cnt")).join(vectors, "token")
    known = pooled.filter("n > 0").select(key, F.col("mean").alias("embedding"), F.col("n").cast("double").alias("cnt"))
    known = known.unionByName(rest.select(key, "embedding", "cnt")).filter(F.col(key).isNotNull())
    names = StructType([docs.select(key).schema[0], StructField("n", DoubleType()), StructField("m", ArrayType(DoubleType()))])
    pooled = known.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(_means(max(dim, 1)), names)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (docs.select(key).join(pooled, key, "left")
            .select(key, F.coalesce(F.col("n").cast("long"), F.lit(0)).cast("long").alias("n_tokens"),
                    F.coalesce("m", zeros).alias("embedding")))


def _hot_means(hot):
    """Rows of (key, token lists): the number and the mean of the vectors of ``hot`` tokens, and the other tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, times = hot.value
        names = pa.array(names, pa.string())
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten()
            at = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy()
            row = np.repeat(np.arange(len(lists)), sizes)
            some = at >= 0
            total, n = np.zeros((len(lists), matrix.shape[1])), np.zeros(len(lists), np.int64)
            rows, which = row[some], at[some]
            for start in range(0, len(rows), HOT_STEP):
                r, w = rows[start:start + HOT_STEP], which[start:start + HOT_STEP]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                total[r[first]] += np.add.reduceat(matrix[w], first, axis=0)
                n[r[first]] += np.add.reduceat(times[w], first)
            np.divide(total, n[:, None], out=total, where=n[:, None] > 0)
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(
                row[~some], minlength=len(lists)))).astype(np.int32)), flat.filter(pa.array(~some)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _lists(total), rest], [
                batch.schema.names[0], "n", "mean", "rest"])
    return run


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def _means(dim: int):
    """Weighted means of the vectors of each key; rows (key, vector, weight) come in order of the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys, n, total):
            return pa.RecordBatch.from_arrays([keys, pa.array(n), _lists(total / n[:, None])], [*names[:1], "n", "m"])
        last = None  # the key that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            names, cnt = batch.schema.names, batch.column(2).to_numpy()
            first = np.append(0, pc.run_end_encode(batch.column(0)).run_ends.to_numpy()[:-1])
            total = np.add.reduceat(batch.column(1).flatten().to_numpy().reshape(-1, dim) * cnt[:, None], first, axis=0)
            n, keys = np.add.reduceat(cnt, first), batch.column(0).take(pa.array(first))
            if last is not None and last[0].equals(keys[:1]):
                total[0] += last[2][0]
                n[0] += last[1][0]
            elif last is not None:
                yield rows(*last)
            if len(n) > 1:
                yield rows(keys[:-1], n[:-1], total[:-1])
            last = keys[-1:], n[-1:], total[-1:]
        if last is not None:
            yield rows(*last)
    return run


def token_table(docs: DataFrame, text_col: str, encoder=None) -> DataFrame:
    """Token-vector table derived from the corpus: every distinct token,
    encoded by ``encoder`` (default: trigram hashing), and how often it occurs."""
    t = docs.select(F.explode(tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    enc = encoder or trigram_encoder()
    return t.select("token", enc(F.col("token")).alias("embedding"), "n")
