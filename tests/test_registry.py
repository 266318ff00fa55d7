"""Driver contract: entry(), queries() and oracle_sql() agree (subset at sf0.001;
the full set runs with ``python tests/oracle_check.py /root/testdata/sf0.01``)."""

import pytest

import __spark_entry__ as se
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"
CHECK = ["j1_topk", "e3_evaluate", "a5_tune_beta", "m5_multinomial_query", "m2_topk_efn_candidate",
         "w5_batches", "a6_batch_loss", "p1_text_topk", "t2_rolling_quality"]


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["query_id", "rank", "corpus_id", "text", "score"]
    assert df.count() > 0


def test_every_sql_key_is_a_query():
    qs, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


@pytest.mark.parametrize("name", CHECK)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name], verbose=False)
    assert res[name][0] is True, res[name]
