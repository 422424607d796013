"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# The numbered operators have their own tests.
QUERIES = {k: v for k, v in QUERIES.items() if not re.match(r"op\d+_|pipeline$", k)}
SQL = {k: v for k, v in SQL.items() if k in QUERIES}
# Nothing to report in the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], DIR) == ("no rows" if name in EMPTY else "")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient_id", "study_id", "start_pos", "num_beats", "beat_idx_start", "beat_idx_end", "tokens"]
    assert df.count() > 0
