"""One key with more than a third of all rows: same rows, by cells instead of whole keys."""

import duckdb
import pytest

import __spark_entry__ as entry
from beatloom.operators import ordered
from beatloom.plans import segment_queries, sentence_queries
from tests.compare import connect, differences

SOURCE = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """Copies of the tables in which one order, one user and one customer are hot."""
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    hot = {
        "lineitem": "* REPLACE (CASE WHEN l_partkey % 5 < 2 THEN 7 ELSE l_orderkey END AS l_orderkey)",
        "events": "* REPLACE (CASE WHEN event_id % 5 < 2 THEN 3 ELSE user_id END AS user_id)",
        "orders": "* REPLACE (CASE WHEN o_orderkey % 5 < 2 THEN 11 ELSE o_custkey END AS o_custkey)",
        "documents": "* REPLACE (CASE WHEN doc_id % 5 < 2 THEN 'src1' ELSE source END AS source)",
    }
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"COPY (SELECT {hot.get(name, '*')} FROM read_parquet('{SOURCE}/{name}.parquet')) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 50)


CASES = {
    "token_sentences": lambda spark, d: sentence_queries.token_sentences(spark, d, cell=16),
    "beat_bounds": lambda spark, d: segment_queries.beat_bounds(spark, d, cell=4),
    "detrended": lambda spark, d: segment_queries.detrended(spark, d, cell=16),
    "peaks": lambda spark, d: segment_queries.peaks(spark, d, cell=16),
}
DEFAULT = [
    "token_sentences", "beat_join", "mlm_masking", "segment_waveforms", "peaks", "detrended", "class_auroc", "record_vote_multi",
    "record_vote_single", "dedup_split", "split_disjoint", "stratified_split", "beat_block", "mean_wave", "code_to_class", "quality_gate",
]


@pytest.mark.parametrize("name", sorted(CASES))
def test_hot_key_in_cells(spark, skewed, small_cells, name):
    assert differences(spark, connect(skewed), CASES[name], SQL[name], skewed) == ""


@pytest.mark.parametrize("name", DEFAULT)
def test_hot_key_default(spark, skewed, small_cells, name):
    assert differences(spark, connect(skewed), entry.queries()[name], SQL[name], skewed) == ""
