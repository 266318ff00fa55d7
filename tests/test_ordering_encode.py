import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairlab.operators import encode
from pairlab.operators.encode import encode_distinct, mean_pool, trigram_encoder, trigram_vector
from pairlab.operators.instances import assign_batches
from pairlab.operators.ordering import exclusive_prefix_sum, with_global_index


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", (F.col("id") * 7919) % 1000)
    out = with_global_index(df, ["k", "id"], "idx").orderBy("idx").toPandas()
    assert list(out.idx) == list(range(1000))
    assert list(out.k) == sorted(out.k)


def test_prefix_sum(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(50)], "v double, w double")
    out = exclusive_prefix_sum(df, "v", "w", "below").orderBy("v").toPandas()
    exp = np.concatenate([[0.0], np.cumsum(out.w.to_numpy())[:-1]])
    assert np.allclose(out.below.to_numpy(), exp)


def test_batches_have_fixed_size_and_short_tail(spark):
    inst = spark.range(0, 70).select(F.col("id").alias("instance_id"))
    b = assign_batches(inst, 32, seed=1, epoch=2).toPandas()
    sizes = b.groupby("batch_id").size().sort_index().tolist()
    assert sizes == [32, 32, 6]
    assert sorted(b.instance_id) == list(range(70))
    again = assign_batches(inst.repartition(5), 32, seed=1, epoch=2).toPandas()
    assert b.sort_values("instance_id").batch_id.tolist() == again.sort_values("instance_id").batch_id.tolist()


def test_encoder_udf_matches_python_and_mean_pool(spark):
    texts = ["abcabc", "zz", "héllo wörld", "the cat sat on the mat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    got = {r.k: np.array(r.embedding) for r in encode_distinct(df, "text", trigram_encoder(32)).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], trigram_vector(t, 32))
    tv = spark.createDataFrame([("the", [1.0, 0.0]), ("cat", [0.0, 1.0])], "token string, embedding array<double>")
    pooled = {r.k: (r.n_tokens, list(r.embedding)) for r in mean_pool(df, "k", "text", tv).collect()}
    assert pooled[3][0] == 3 and np.allclose(pooled[3][1], [2 / 3, 1 / 3])   # 'the' x2, 'cat' x1
    assert pooled[1] == (0, [0.0, 0.0])
    trunc = {r.k: r.n_tokens for r in mean_pool(df, "k", "text", tv, max_tokens=2).collect()}
    assert trunc[3] == 2   # 'the', 'cat' of the first two tokens


def test_batch_encoder_equals_text_by_text(monkeypatch):
    texts = [None, "", "ab", "abc", "h\u00e9llo \U0001f600 w\u00f6rld", "xyz" * 5000, "abc", "the cat"]
    batch = pa.array([*texts, "cut off"])
    want = np.stack([trigram_vector(t, 32) for t in texts])
    assert np.array_equal(encode.trigram_matrix(batch.slice(0, len(texts)), 32), want)
    assert np.array_equal(encode.trigram_matrix(batch.slice(3, 5), 32), want[3:])
    for most in (1, 5, 100, 1 << 20):
        monkeypatch.setattr(encode, "BATCH_CHARS", most)
        parts = list(encode._pieces(batch))
        assert sum(map(len, parts)) == len(batch) and all(map(len, parts))
        assert np.array_equal(np.concatenate([encode.trigram_matrix(p, 32) for p in parts])[:-1], want)
