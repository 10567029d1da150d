"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Right to be empty on tables this small; all have rows at the next size.
EMPTY_HERE = {
    "extract_incremental", "graph_connecting", "graph_direct_cycles", "graph_self_references", "graph_start", "keyset_page", "lineage_spikes",
}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    problem = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert problem is None or (problem == "no rows" and name in EMPTY_HERE)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
