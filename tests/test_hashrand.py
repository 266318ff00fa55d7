import duckdb
import numpy as np
from pyspark.sql import functions as F

from pairlab.functions import hashrand as hr

BIG = [0, 1, 5, -1, -77, 2**31 - 1, 2**31 - 2, 2**31, 2**40 + 3, 2**62, -2**50]


def test_three_renderings_agree(spark):
    ids = np.array(BIG + list(range(100, 3000)), dtype=np.int64)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "k long, id long")
    df = df.withColumn("slot", F.col("k") % 7)
    pdf = df.select("k", hr.wide_expr(7, 3, "id", "slot").alias("h"), hr.uniform_expr(9, "id").alias("u")) \
            .orderBy("k").toPandas()
    slot = np.arange(len(ids)) % 7
    assert (pdf.h.values == hr.wide_np(7, 3, ids, slot)).all()
    assert (pdf.u.values == hr.unit_np(hr.wide_np(9, ids))).all()
    con = duckdb.connect()
    con.register("t", df.toPandas())
    d = con.sql(f"select k, {hr.wide_sql(7, 3, 'id', 'slot')} h, {hr.uniform_sql(9, 'id')} u, "
                f"{hr.pair_unit_sql((9, 'id'), 'k*3')} pu from t order by k").df()
    assert (d.h.values == pdf.h.values).all() and (d.u.values == pdf.u.values).all()
    pu = hr.pair_unit_np(hr.wide_np(9, ids), hr.wide_np(np.arange(len(ids)) * 3))
    assert (d.pu.values == pu).all()


def test_keys_that_agree_modulo_the_word_size_differ():
    ids = np.arange(1, 50_000, dtype=np.int64)
    far = ids + hr.P * 3
    assert (hr.wide_np(1, ids) != hr.wide_np(1, far)).all()
    every = np.concatenate([hr.wide_np(1, x) for x in (ids, far, -ids - 1, ids << 33)])
    assert len(np.unique(every)) == len(every)
    assert every.min() >= 0 and every.max() < 1 << 62


def test_uniformity():
    u = hr.unit_np(hr.wide_np(1, 2, np.arange(200_000)))
    assert 0 < u.min() and u.max() < 1
    for x in (u, (u * 2.0**31) % 1.0):
        hist = np.histogram(x, bins=50, range=(0, 1))[0]
        assert ((hist - 4000) ** 2 / 4000).sum() < 100   # 49 dof
