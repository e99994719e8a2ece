"""Every registered query with SQL gives the SQL's rows; the others run and give rows."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

# Fits repeat what other tests cover; here one of each kind is enough.
SLOW = {"locked_evaluation", "candidate_comparison", "strategy_comparison", "metric_bars", "random_search", "frozen_threshold"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


OWN = {n for n in queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()}  # tested in tests/llm


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - OWN))
def test_query_matches_sql(spark, sf, con, name):
    assert compare(queries()[name](spark, sf), con, oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW - OWN))
def test_query_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
