"""Every registered query against its SQL on the given tables."""

import compare
import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert name in ORACLE, "every query so far can be said in SQL"
    assert compare.compare(spark, con, sf_dir, name, entry.queries()[name], ORACLE[name]) is None


def test_entry_runs(spark):
    result = entry.entry(spark)
    assert result.columns == ["status", "episodes", "with_state", "mean_value", "mean_held_ms"]
    assert result.count() > 0
