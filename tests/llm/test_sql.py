"""Queries of the llm subpackage against their SQL."""

from __future__ import annotations

import pytest
from compare import duck_rows, spark_rows

from tableloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    got, want = spark_rows(queries.queries()[name](spark, SF)), duck_rows(queries.oracle_sql()[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
    assert not wrong, wrong[:3]
