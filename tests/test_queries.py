"""A few registered queries against the same query in SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gaugework.queries import all_sql
from gaugework.queries.views import TABLES

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "best_record_per_kpi", "normalize_units", "compare_companies", "rank_percentile", "merge_label_value",
    "keyword_index", "revenue_pick", "discovery_filter", "multi_query_search", "active_metrics", "metrics_by_name",
    "landed_files", "found_of_requested", "hybrid_retrieval", "record_log", "parse_cache",
    "company_years_from_reports", "chunk_index", "parse_meta", "status_fold", "ingest_outcomes",
]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_every_sql_runs(sql, name):
    """Each query's SQL names tables and columns that are there."""
    names = [d[0] for d in sql.execute(all_sql()[name]).description]
    assert len(names) == len(set(names))


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
