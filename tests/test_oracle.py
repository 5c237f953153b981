"""Registered queries against DuckDB on the smallest tables.

The default run takes every third across all families; DEALFLUX_ALL=1 runs every query
(``python check.py`` does the same at a chosen scale).
"""

import os

import pytest

from check import compare, connect
from conftest import DATA
from dealflux.catalog import registry

registry.load()
NAMES = sorted(registry.QUERIES)
CHOSEN = NAMES if os.environ.get("DEALFLUX_ALL") else [n for i, n in enumerate(NAMES) if i % 3 == 0 or n in ("evt_markov", "evt_funnel")]


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", [n for n in CHOSEN if n in registry.ORACLES])
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toArrow()
    assert compare(got, duck.sql(registry.ORACLES[name]).to_arrow_table()) is None


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 250
