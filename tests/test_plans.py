"""Properties of physical plans that matter at scale."""

import re

import pytest

from saltcellar.functions.columns import in_scope
from saltcellar.operators import customers, menu, sales, views
from saltcellar.plans.samples import Samples
from saltcellar.sources import sinks

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def samples(spark):
    return Samples(spark, FOLDER)


def test_dedup_limits_each_key_before_the_shuffle(samples):
    plan = plan_of(views.orders_clean(samples.raw_orders))
    assert plan.count("WindowGroupLimit") == 2
    partial = plan.rindex("WindowGroupLimit")
    exchange = plan.index("Exchange hashpartitioning(order_guid")
    assert exchange < partial, "the partial limit stands below the exchange"


@pytest.mark.parametrize(
    "build",
    [
        lambda t: t.gold, lambda t: t.profiles, lambda t: menu.promo_opportunities(t.gold), lambda t: sales.menu_performance(t.raw_items, t.stored_inventory),
        lambda t: customers.customer_profiles_rows(t.stored_masked, t.stored_orders), lambda t: t.items, lambda t: t.name_map,
    ],
)
def test_no_cross_joins_or_gathered_windows(samples, build):
    plan = plan_of(build(samples))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    windows = re.findall(r"Window \[.*?windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert all(w.strip() for w in windows)
    assert "Exchange SinglePartition" not in plan


def test_filters_and_columns_reach_the_scan(samples):
    plan = plan_of(sales.sales_summary(samples.stored_orders, ["demo_asia"], "19980101", "19981231"))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(business_date,1998-01-01)" in plan
    assert "EqualTo(location_id,demo_asia)" in plan or "In(location_id" in plan
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "order_time" not in schema and "total_amount" in schema


def test_location_filter_prunes_partitions(spark, samples, tmp_path):
    path = str(tmp_path / "orders")
    sinks.write_table(samples.raw_orders, path, "overwrite")
    plan = plan_of(in_scope(spark.read.parquet(path), ["demo_asia"], "19980101").select("order_guid"))
    assert re.search(r"PartitionFilters: \[.*location_id", plan) and "GreaterThanOrEqual(business_date,19980101)" in plan


def test_small_name_map_is_broadcast_and_items_are_not_shuffled_for_it(spark, samples):
    items = samples.raw_items.limit(0).unionByName(samples.raw_items)
    plan = plan_of(views.item_performance(items, samples.stored_map))
    assert "BroadcastHashJoin [item_name" in plan and "Exchange hashpartitioning(item_name" not in plan


def test_distinct_counts_need_no_expand(samples):
    assert "Expand" not in plan_of(samples.profiles)
