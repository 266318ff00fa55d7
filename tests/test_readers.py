import os
import tempfile

from pyspark.sql import functions as F

from pairlab.session import ensure_checkpoint_dir
from pairlab.sources.fixtures import vector_fixture
from pairlab.sources.readers import read_dictionary, read_pairs, read_testset


def _dir(spark):
    base = ensure_checkpoint_dir(spark)
    return tempfile.mkdtemp(prefix="readers-", dir=base if os.path.isdir(base) else None)


def test_text_dictionary_positions_follow_line_order(spark):
    fx = vector_fixture(spark, "/root/testdata/sf0.001")
    d = _dir(spark)
    cands = fx.candidates.orderBy("corpus_id").select("text").toPandas()
    with open(f"{d}/cands.txt", "w") as fh:
        fh.write("\n".join(cands.text) + "\n")
    got = read_dictionary(spark, f"{d}/cands.txt").orderBy("corpus_id").toPandas()
    assert list(got.corpus_id) == list(range(len(cands)))
    assert list(got.text) == list(cands.text)


def test_pairs_tsv_roundtrip(spark):
    fx = vector_fixture(spark, "/root/testdata/sf0.001")
    d = _dir(spark)
    pdf = fx.validation.orderBy("row_id").select("text1", "text2", "label").toPandas()
    pdf.to_csv(f"{d}/validation.csv", sep="\t", index=False)
    got = read_pairs(spark, f"{d}/validation.csv").orderBy("row_id").toPandas()
    assert list(got.row_id) == list(range(len(pdf)))
    assert list(got.text2) == list(pdf.text2) and list(got.label) == list(pdf.label)


def test_testset_long_and_nested(spark):
    d = _dir(spark)
    long = spark.createDataFrame([("qa", "x"), ("qb", "y"), ("qa", "z"), ("qc", "x")], "query string, label string")
    long.coalesce(1).write.parquet(f"{d}/long")
    got = {r.query: (r.query_id, list(r.labels)) for r in read_testset(spark, f"{d}/long", "long").collect()}
    assert got == {"qa": (0, ["x", "z"]), "qb": (1, ["y"]), "qc": (2, ["x"])}
    nested = spark.createDataFrame([("qa", ["x", "z"]), ("qb", ["y"])], "query string, labels array<string>")
    nested.coalesce(1).write.parquet(f"{d}/nested")
    got2 = read_testset(spark, f"{d}/nested").orderBy("query_id").collect()
    assert [(r.query_id, r.query) for r in got2] == [(0, "qa"), (1, "qb")]
    assert F is not None
