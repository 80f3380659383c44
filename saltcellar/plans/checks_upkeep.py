"""Committed loads and views kept up by touched days, over the sample tables, with SQL checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltcellar.functions.columns import cents, day_text, parse_day
from saltcellar.plans import checks_sales
from saltcellar.session import remove_at_exit, scratch_path, stored
from saltcellar.sources.files import MONTH
from saltcellar.sources.warehouse import Warehouse
from saltcellar.streaming.upkeep import ViewStore, standard_views

CUT = "19980101"  # days from here on come with the first load, older ones late


def _root(t, label):
    path = scratch_path(t.spark, label)
    remove_at_exit(t.spark, path)
    return path


def _kept(t, raw, first, late, views):
    """A store that has taken two loads, the second one of old days, and refreshed after each."""
    known = standard_views(t.stored_map if raw == "order_items" else t.name_map)  # views of orders read no map: it is not stored for them
    store = ViewStore(t.spark, _root(t, "kept"), {name: known[name] for name in views}, MONTH, buckets=16)
    for name, rows in (("first", first), ("late", late)):
        store.refresh(raw, store.load(rows, raw, name))
    return store


def _order_loads(t):
    """First the new days, and second copies of orders under the day after; then all the rest, with the copies that stay.

    The rows are made once and stored with their load. Rows without a day, other than copies, are in none."""
    is_second = F.coalesce(F.col("order_type") == "Takeout", F.lit(False))
    has_second = F.col("order_guid").isNotNull() & F.max(is_second).over(Window.partitionBy("order_guid"))
    is_first = F.when(is_second, True).when(has_second, False).otherwise(F.col("business_date") >= CUT)
    moved = F.when(is_second, day_text(F.date_add(parse_day(F.col("business_date")), 1))).otherwise(F.col("business_date"))
    rows = stored(t.raw_orders.withColumn("is_first", is_first).withColumn("business_date", moved), "order-loads")
    return rows.filter("is_first").drop("is_first"), rows.filter("NOT is_first").drop("is_first")


def _orders_refreshed(t):
    return _kept(t, "orders", *_order_loads(t), ["orders_clean"]).view("orders_clean")


def _daily_refreshed(t):
    return _kept(t, "orders", *_order_loads(t), ["orders_clean", "daily_sales"]).view("daily_sales")


def _item_loads(t):
    new = F.col("business_date") >= CUT
    return t.raw_items.filter(new), t.raw_items.filter(~new)


def _items_refreshed(t):
    return _kept(t, "order_items", *_item_loads(t), ["order_items_clean"]).view("order_items_clean")


def _item_sales_refreshed(t):
    return _kept(t, "order_items", *_item_loads(t), ["order_items_clean", "item_performance"]).view("item_performance")


def _committed(t):
    """Loads with their log rows: one given twice, one broken off before its commit, small ones put together afterwards."""
    house = Warehouse(t.spark, _root(t, "house"))
    for number, place in enumerate(("asia", "europe")):
        for _ in range(number + 1):
            rows = t.raw_payments.filter(F.col("location_id").contains(place))
            counted = rows.groupBy("location_id", "business_date").agg(F.count(F.lit(1)).alias("rows_imported"))
            log = counted.withColumns({"import_id": F.md5(F.concat("location_id", "business_date")), "file_type": F.lit("CSV"), "file_name": F.lit(place)})
            house.load({"payments": rows, "import_log": log}, place)
    house.stage(t.raw_payments, "payments", "broken")
    house.compact("payments")
    logged = house.read("import_log").groupBy("location_id").agg(F.sum("rows_imported").alias("logged"))
    paid = house.read("payments").groupBy("location_id").agg(F.count(F.lit(1)).alias("rows"), cents(F.col("amount")).alias("amount"))
    loads = house.folders().filter("table = 'payments'").agg(F.count(F.lit(1)).alias("loads"))
    return paid.join(logged, "location_id").crossJoin(loads)


QUERIES = {
    "orders_clean_refreshed": _orders_refreshed,
    "daily_sales_refreshed": _daily_refreshed,
    "order_items_clean_refreshed": _items_refreshed,
    "item_performance_refreshed": _item_sales_refreshed,
    "committed_loads": _committed,
}

SQL = {
    "orders_clean_refreshed": checks_sales.SQL["orders_clean"],
    "daily_sales_refreshed": checks_sales.SQL["daily_sales"],
    "order_items_clean_refreshed": checks_sales.SQL["order_items_clean"],
    "item_performance_refreshed": checks_sales.SQL["item_performance"],
    "committed_loads": """
        SELECT location_id, count(*) AS rows, round(sum(amount), 2) AS amount, count(*) AS logged, 1 AS loads FROM raw_payments
        WHERE location_id LIKE '%asia%' OR location_id LIKE '%europe%' GROUP BY location_id""",
}
