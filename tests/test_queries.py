"""Registered queries against their SQL on the smallest data set; skipped without the data."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check_queries import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
# A quick cross-section; tools/check_queries.py runs all of them.
CHECKED = [
    "prepare_reviews", "column_profile", "duplicates_by_platform", "reconcile_counts", "seed_identities", "author_pseudonym",
    "unique_texts", "neighbours_one", "quantise_int8", "class_bow", "topic_keywords", "silhouette", "sentiment_by_topic",
    "mart_kpis", "label_margins", "split_distribution", "validate_interpretations",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    status, _, _, note = compare(spark, con, name, SF)
    assert status.startswith("ok"), note


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
