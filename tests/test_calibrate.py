import pytest
from pyspark.sql import functions as F

from pairlab.operators.calibrate import EpochConfig, beta_ladder, tune_beta

B1 = ([.95, .9, .85, .7, .6, .55], [1, 1, 0, 1, 0, 0])

CASES = [
    ("B1", *B1, 0.8, 0.8600000000000003),
    ("B2", [.6, .7], [0, 0], 0.8, 0.7250000000000002),
    ("B3", [], [], 0.8, 0.5),
    ("B4", [.3, .2], [1, 1], 0.8, 0.515),
    ("B5", [.6, .7], [1, 1], 0.8, 0.5),
    ("B6", *B1, 0.6, 0.56),
]


@pytest.mark.parametrize("name,sims,labels,alpha,expected", CASES)
def test_tune_beta_goldens(spark, name, sims, labels, alpha, expected):
    df = spark.createDataFrame([(float(s), float(y)) for s, y in zip(sims, labels)],
                               "score double, label double")
    row = tune_beta(df, alpha).collect()[0]
    assert row.beta == expected


def test_nan_is_dropped(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (0.9, 1.0)], "score double, label double")
    assert tune_beta(df, 0.8).collect()[0].beta == 0.5


def test_ladder_is_accumulated():
    lad = beta_ladder()
    assert lad[24] == 0.8600000000000003
    assert lad[34] == 1.0100000000000005


def test_epoch_schedule():
    assert EpochConfig.for_epoch(1).alpha == 0.8150000000000001
    assert EpochConfig.for_epoch(0).positive_threshold == 0.0
    assert EpochConfig.for_epoch(3).positive_threshold == 0.5
    assert EpochConfig.for_epoch(0).effective_beta(0.86) == 1.0


def test_batch_plan():
    assert EpochConfig.batch_plan(13) == {"evaluation_steps": 4, "warmup_steps": 2}


def test_batch_plan_columns(spark):
    plan = spark.range(200).select("id", *EpochConfig.batch_plan_columns(F.col("id"))).collect()
    assert [r.asDict() for r in plan] == [{"id": n, **EpochConfig.batch_plan(n)} for n in range(200)]
