import os
import tempfile

from pyspark.sql import functions as F

from pairlab.plans.evaluate import append_results
from pairlab.session import ensure_checkpoint_dir


def test_result_log_appends(spark):
    base = ensure_checkpoint_dir(spark)
    path = tempfile.mkdtemp(prefix="results-", dir=base if os.path.isdir(base) else None)
    row = spark.range(1).select(F.lit(0.8).alias("alpha"), F.lit(0.86).alias("beta"),
                                F.lit(0.3066).alias("ndcg"))
    append_results(row, path, "run-a", "m", 0)
    append_results(row, path, "run-b", "m", 1)
    got = spark.read.parquet(path).orderBy("epoch").collect()
    assert [(r.run_id, r.epoch) for r in got] == [("run-a", 0), ("run-b", 1)]


def test_write_epoch_partitions_by_epoch(spark):
    from pairlab.operators.calibrate import EpochConfig
    from pairlab.plans.epoch import prepare_epoch, write_epoch
    from pairlab.sources.fixtures import vector_fixture
    fx = vector_fixture(spark, "/root/testdata/sf0.001")
    base = ensure_checkpoint_dir(spark)
    out = tempfile.mkdtemp(prefix="epochs-", dir=base if os.path.isdir(base) else None)
    data = prepare_epoch(fx.training, fx.validation, fx.queries, fx.candidates,
                         EpochConfig.for_epoch(1, seed=3), output_path=out)
    back = spark.read.parquet(f"{out}/instances")
    assert back.select("epoch").distinct().collect()[0][0] == 1
    assert back.count() == data.instances.count()
    assert set(back.columns) >= {"instance_id", "row_id", "texts", "label", "batch_id", "pos"}
    sizes = back.groupBy("batch_id").count().toPandas()["count"]
    assert (sizes <= 32).all() and (sizes == 32).sum() >= len(sizes) - 1
    assert 0.5 <= data.tuned_beta <= 1.1 and data.beta == data.tuned_beta
