"""Plan hygiene: no registered query plans a nested-loop or cartesian join."""

import __spark_entry__ as se

SF = "/root/testdata/sf0.001"


def test_no_cross_joins_in_any_registered_plan(spark):
    offenders = []
    for name, fn in se.queries().items():
        if name.startswith("t"):        # streams: their batches run the same kernel as j1
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "NestedLoop" in plan or "Cartesian" in plan:
            offenders.append(name)
    assert offenders == []


def test_flagship_plan_prunes_columns_and_hash_joins(spark):
    plan = se.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "ReadSchema: struct<vec_id:bigint>" in se.entry(spark)._jdf.queryExecution().toString() or \
        "struct<vec_id:bigint>" in plan
