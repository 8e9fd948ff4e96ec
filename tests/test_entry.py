"""Driver contract: entry() and every registered query run on sf0.001; oracle keys are queries."""

import pytest

import __spark_entry__ as E
from conftest import SF001


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 7 and df.columns[0] == "model" and "overall_score" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


#: Queries whose result is empty on this small input.
MAY_BE_EMPTY = set()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs_sf0001(spark, name):
    df = E.queries()[name](spark, SF001)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    assert len(set(df.columns)) == len(df.columns) > 0 and "void" not in dict(df.dtypes).values()
    assert all(len(r) == len(df.columns) for r in rows)
