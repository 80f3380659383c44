"""Committed loads, compaction, and views kept up by touched periods."""

from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.operators import views
from saltcellar.plans import checks_upkeep
from saltcellar.sources.files import DAY_GRAIN, MONTH, read_table
from saltcellar.sources.sinks import write_table
from saltcellar.sources.warehouse import Warehouse
from saltcellar.streaming.upkeep import ViewStore, standard_views

MAP = "item_name string, canonical_name string, display_name string, category string"


def _orders(spark, rows):
    """(order, location, day, total, hour of creation)"""
    made = [
        (guid, place, day, guid, f"2026-01-01T{hour:02d}:00:00.000Z", "DELIVERY", float(total), float(total), 0.0, 0.0, 0.0, hour)
        for guid, place, day, total, hour in rows
    ]
    names = "order_id location_id business_date order_guid order_time order_type total_amount subtotal tax_amount tip_amount discount_amount hour"
    frame = spark.createDataFrame(made, ", ".join(f"{n} {'double' if 'amount' in n or n == 'subtotal' else 'int' if n == 'hour' else 'string'}" for n in names.split()))
    return frame.withColumn("created_at", F.timestamp_seconds(F.col("hour") * 3600)).drop("hour")


def _items(spark, rows):
    return spark.createDataFrame([(g, i, "", 1, float(p), float(p), place, day) for g, i, p, place, day in rows],
                                 "order_guid string, item_name string, category string, quantity long, prediscount_total double, total_price double, location_id string, business_date string")


def _store(spark, tmp_path, grain=DAY_GRAIN):
    return ViewStore(spark, str(tmp_path / "kept"), standard_views(spark.createDataFrame([("a", "A", "A", None)], MAP)), grain, buckets=4)


def _same(store, name, raw):
    full = {"orders_clean": views.orders_clean, "daily_sales": lambda r: views.daily_sales(views.orders_clean(r))}[name](raw)
    got = store.view(name)
    assert sorted(map(str, got.select(*full.columns).collect())) == sorted(map(str, full.collect()))


FIRST = [("o1", "s1", "20260101", 10, 5), ("o2", "s1", "20260101", 20, 6), ("o3", "s1", "20260102", 30, 5), ("o4", "s2", "20260203", 40, 5), ("o5", "s2", "no day", 50, 5), ("o7", "s2", "", 5, 5)]
# An earlier copy of o1 on another day takes its place; a later copy of o3 does not; o4's only day loses it.
LATE = [("o1", "s1", "20251231", 11, 1), ("o3", "s1", "20260105", 31, 9), ("o4", "s2", "20260104", 41, 2), ("o6", "s1", "20260102", 60, 5)]


@pytest.mark.parametrize("grain", [DAY_GRAIN, MONTH])
def test_refreshed_views_equal_full_ones(spark, tmp_path, grain):
    store = _store(spark, tmp_path, grain)
    first, late = _orders(spark, FIRST), _orders(spark, LATE)
    touched = store.refresh("orders", store.load(first, "orders", "l1"))
    assert touched == sorted({None, *("20260101 20260102 20260203".split() if grain == DAY_GRAIN else "202601 202602".split())}, key=str)
    for name in ("orders_clean", "daily_sales"):
        _same(store, name, first)
    touched = store.refresh("orders", store.load(late, "orders", "l2"))
    if grain == DAY_GRAIN:
        assert touched == ["20251231", "20260101", "20260102", "20260104", "20260105", "20260203"]
    for name in ("orders_clean", "daily_sales"):
        _same(store, name, first.union(late))
    folders = {p.name for p in (tmp_path / "kept" / "orders_clean").iterdir() if p.is_dir()}
    assert ("period=20260203" in folders, "period=202602" in folders) == (False, False)  # nothing is left there
    # A load given again under its name takes the place of the earlier one, also by nothing.
    if grain == DAY_GRAIN:
        store.refresh("orders", store.load(first.limit(0), "orders", "l1"))
        store.refresh("orders", store.load(first.limit(0), "orders", "l2"))
        assert store.view("orders_clean").collect() == [] and store.view("daily_sales").collect() == []
        return
    again = _orders(spark, LATE[2:3])
    store.refresh("orders", store.load(again, "orders", "l2"))
    for name in ("orders_clean", "daily_sales"):
        _same(store, name, first.union(again))


def test_item_views_and_empty_loads(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = [("o1", "a", 1, "s1", "20260101"), ("o1", "a", 1, "s1", "20260103"), ("o2", "a", 2, "s1", "20260101"), ("o2", "b", 2, "s1", "20260102")]
    name_map = spark.createDataFrame([("a", "A", "A", None)], MAP)
    assert store.view("order_items_clean").collect() == [] and store.view("daily_sales").collect() == []
    assert store.refresh("order_items", store.load(_items(spark, rows).limit(0), "order_items", "none")) == []
    store.refresh("order_items", store.load(_items(spark, rows[1:]), "order_items", "x"))
    store.refresh("order_items", store.load(_items(spark, rows[:1]), "order_items", "y"))
    raw = _items(spark, rows)
    for name, full in (("order_items_clean", views.order_items_clean(raw, name_map)), ("item_performance", views.item_performance(raw, name_map))):
        assert sorted(map(str, store.view(name).select(*full.columns).collect())) == sorted(map(str, full.collect()))


def test_a_refresh_reads_touched_folders_only(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.refresh("orders", store.load(_orders(spark, [(f"o{i}", "s1", f"202601{1 + i % 28:02d}", i, 5) for i in range(280)]), "orders", "l1"))
    changed = store.load(_orders(spark, [("o3", "s1", "20260104", 1, 1)]), "orders", "l2")
    periods = store.touched("orders", changed)
    assert periods == ["20260104"]
    found = store.rebuilt("orders_clean", changed.select("unit").distinct(), periods)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 2 and plan.count("period") >= 2
    files = {f.split("period=")[1].split("/")[0] for f in found.inputFiles() if "period=" in f}
    assert store.house.read("orders", F.col("period").isin(periods)).count() == 11 and "20260104" in files
    assert all("period" in line.split("PartitionFilters: ")[1].split("]")[0] for line in plan.splitlines() if "FileScan parquet" in line and "kept/" in line)


def _payments(spark, *rows):
    return spark.createDataFrame([(g, "CASH", 1.0, d, "s", d) for g, d in rows], "order_guid string, payment_method string, amount double, payment_date string, location_id string, business_date string")


def _log(spark, n):
    return spark.createDataFrame([(f"i{n}", "s", "20260101", "CSV", "f", n)], "import_id string, location_id string, business_date string, file_type string, file_name string, rows_imported long")


def test_loads_commit_as_one_and_compact(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "w"))
    assert house.read("payments").collect() == [] and house.read("payments").schema.names == schemas.TABLES["payments"].names
    assert house.load({"payments": _payments(spark, ("a", "20260101"), ("b", "")), "import_log": _log(spark, 2)}, "one") == {"payments": 2, "import_log": 1}
    house.load({"payments": _payments(spark, ("c", "20260201")), "import_log": _log(spark, 1)}, "two")
    broken = house.stage(_payments(spark, ("z", "20260101")), "payments", "three")
    with pytest.raises(Exception):
        house.load({"payments": _payments(spark, ("y", "20260101")), "import_log": _log(spark, 1).drop("import_id").withColumn("import_id", F.raise_error(F.lit("stop")))}, "four")
    rows = lambda: sorted((r["order_guid"], r["business_date"]) for r in house.read("payments").collect())
    want = [("a", "20260101"), ("b", ""), ("c", "20260201")]
    assert rows() == want and house.read("import_log").count() == 2
    assert len(house.unread("payments")) == 2
    house.load({"payments": _payments(spark, ("c", "20260202"))}, "two")  # replaces rows and their log row
    want[2] = ("c", "20260202")
    assert rows() == want and house.read("import_log").count() == 1
    assert house.compact("payments") == 2 and house.compact("payments") == 0
    assert rows() == want and house.folders().filter("table = 'payments'").count() == 1
    house.commit("three", [broken])
    assert rows() == [*want, ("z", "20260101")]
    assert [r["order_guid"] for r in house.read("payments", F.col("period") == "202602").collect()] == ["c"]


def test_period_folders_of_a_table(spark, tmp_path):
    path = str(tmp_path / "orders")
    raw = _orders(spark, FIRST + LATE)
    assert write_table(raw, path, "overwrite") == 10
    assert {p.name for p in (tmp_path / "orders").iterdir() if p.is_dir()} == {"location_id=s1", "location_id=s2"}
    got = read_table(spark, path, "orders")
    assert sorted(map(str, got.select(*raw.columns).collect())) == sorted(map(str, raw.collect()))
    part = read_table(spark, path, "orders", "20260102", "20260131")
    assert {r["order_guid"] for r in part.collect()} == {"o3", "o4", "o6"}
    assert "PartitionFilters: [" in part._jdf.queryExecution().executedPlan().toString()


def test_refreshes_write_rows_once_and_shuffle_them_once(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path, MONTH)
    labels, kept = [], ViewStore._stored
    monkeypatch.setattr(ViewStore, "_stored", lambda self, df, label: labels.append(label) or kept(self, df, label))
    first, late = _orders(spark, [*FIRST, (None, "s1", "20260103", 7, 5), ("", "s1", "20260204", 8, 5)]), _orders(spark, LATE)
    store.refresh("orders", store.load(first, "orders", "l1"))
    changed = store.load(late, "orders", "l2")
    assert store.refresh("orders", changed) == ["202512", "202601", "202602"]
    assert labels == ["changed-orders"] * 2  # (order, period) alone is written beside the store, once a load
    for name in ("orders_clean", "daily_sales"):
        _same(store, name, first.union(late))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # raw rows, old rows, and the units for each: the view's removal of copies adds none
        plan = store.rebuilt("orders_clean", changed.select("unit"), ["202601"], False)._jdf.queryExecution().sparkPlan().toString()
        found = store.rebuilt("orders_clean", changed.select("unit"), ["202601"], False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "LeftSemi" in plan and found.count("Exchange hashpartitioning") <= 4


def test_order_loads_with_odd_rows(spark):
    rows = [("a", "20000101", "Takeout"), ("a", "20000101", "API"), ("b", "19970101", "API"), ("b", "19970101", None), ("c", None, "API"),
            (None, "19990101", "Takeout"), (None, "19990101", "API"), ("d", "no day", "Takeout"), ("d", None, "API"), ("e", "19980101", "API")]
    orders = spark.createDataFrame([(*row, 1.0) for row in rows], "order_guid string, business_date string, order_type string, total double")
    first, late = checks_upkeep._order_loads(SimpleNamespace(raw_orders=orders))
    key = lambda df: sorted(map(str, df.select("order_guid", "business_date", "order_type", "total").toLocalIterator()))
    made = lambda *some: sorted(str(Row(order_guid=g, business_date=d, order_type=k, total=1.0)) for g, d, k in some)
    assert key(first) == made(("a", "20000102", "Takeout"), (None, "19990102", "Takeout"), (None, "19990101", "API"), ("d", None, "Takeout"), ("e", "19980101", "API"))
    assert key(late) == made(("a", "20000101", "API"), ("b", "19970101", "API"), ("b", "19970101", None), ("d", None, "API"))
    assert first.columns == late.columns == orders.columns
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # rows are made once, not again for each load
