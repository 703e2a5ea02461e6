"""Driver contract and the DuckDB oracle at sf0.001."""

import pytest

from conftest import SF_SMALL
from __spark_entry__ import entry, oracle_sql, queries
from oracle_util import compare, duck


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["period_h", "row", "col", "n"]


def test_oracle_keys_subset():
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, con, name):
    assert compare(spark, name, SF_SMALL, con, verbose=False)
