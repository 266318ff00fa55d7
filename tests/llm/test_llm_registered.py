"""Registered queries that SQL can express agree with DuckDB."""

import pytest

import __spark_entry__ as se
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"
SQL = ["op2_chat_format", "op3_decontaminate", "op7_url_filter", "op8_ngram_join", "op10_secrets", "op11_prefix_trie",
       "op13_substring_dedup"]


def test_all_operators_are_registered():
    names = list(se.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, name):
    res = compare(spark, SF, [name], verbose=False)
    assert res[name][0] is True, res[name]
