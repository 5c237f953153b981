"""Queries that SQL can express, against DuckDB on the smallest tables."""

import pytest
from check import compare, connect
from llm_fixtures import DATA

from dealflux.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    got = queries.QUERIES[name](spark, DATA).toArrow()
    assert compare(got, connect(DATA).sql(queries.ORACLES[name]).to_arrow_table()) is None
