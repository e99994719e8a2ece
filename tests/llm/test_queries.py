"""Every corpus query with SQL gives the SQL's rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
import riskframe.llm.queries  # noqa: E402, F401
from riskframe.llm.registry import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == ""


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language identification", "line dedup", "near duplicates", "benchmark decontamination", "mixing"]
