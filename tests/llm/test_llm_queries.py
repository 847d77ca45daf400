"""Queries that SQL can express, next to their SQL."""

import pytest

from checks.compare import duck, rows_of
from unitloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, name):
    got = QUERIES[name](spark, SF)
    result = duck(SF).execute(SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in result.description], result.fetchall())
