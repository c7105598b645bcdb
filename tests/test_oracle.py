"""Every registered query with SQL gives the same rows as DuckDB over whole tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, queries
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_duckdb(spark, con, name):
    assert differences(queries()[name](spark, SF_DIR), con, ORACLE[name]) == []


def test_every_query_is_checked_or_is_a_factor_model():
    assert set(QUERIES) - set(ORACLE) == {"recommend_artists", "recommend_songs"}


def test_entry_runs(spark):
    answer = entry(spark)
    assert answer.columns == ["sessionId", "sessionLength", "user", "artist", "song"]
    assert answer.count() > 0
