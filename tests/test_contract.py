"""Registered queries against their SQL on the smallest sample folder."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, _rows

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "orders_clean", "order_items_clean", "customers_masked", "daily_sales", "sales_by_channel", "item_gold", "item_kpis", "bundle_pairs", "promo_opportunities",
    "rfm_segments", "spend_histogram", "flatten_orders", "flatten_order_items", "media_snapshots", "question_weekly_revenue", "question_category_revenue_mix",
    "engagement_features", "peak_lag", "sync_range", "new_files", "snapshot_append", "import_orders",
)


def test_names_agree():
    named = lambda found: {name for name in found if not re.match(r"op\d+_|pipeline$", name)}  # those have tests of their own
    queries, oracle = named(contract.queries()), named(contract.oracle_sql())
    assert set(oracle) <= set(queries) and len(queries) > 140
    assert set(queries) - set(oracle) == {"topic_model", "topic_table", "predictive_summary", "ols_hc3", "dynamic_panel", "response_curves"}


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    frame = contract.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in frame.collect()]
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert _rows(frame.columns, got) == _rows(names, result.fetchall())
