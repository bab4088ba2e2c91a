"""The driver contract, and a spread of queries next to their SQL twins."""

import pytest

import __spark_entry__ as entry
import check_oracle

from scoreloom.plans import all_queries

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(all_queries.QUERIES)


@pytest.fixture(scope="module")
def twins(sf):
    return check_oracle.connect(sf)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 200


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 3 and all(0.0 <= r["auc"] <= 1.0 for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query_runs_and_equals_its_twin(spark, sf, twins, name):
    ok, note = check_oracle.compare(spark, twins, name, all_queries.QUERIES[name], all_queries.SQL.get(name), sf)
    assert ok, note
