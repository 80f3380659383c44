"""Named questions over the warehouse tables, each one parameterized query.

`Tables` is what a question may read; it holds permitted tables only. `ask` runs a question
the way an end user gets it: small groups taken out, raw identifiers refused.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltcellar.functions.columns import cents, in_scope, mean_cents, parse_day, ratio
from saltcellar.operators.customers import customer_order_bins, customer_profiles
from saltcellar.operators.privacy import guard_output, min_group, permitted, suppress_small

Locations = Sequence[str] | None

# Tables a question may read, order types told apart, the smallest group.
QUESTION_TABLES = (
    "orders", "order_items", "orders_clean", "order_items_clean", "inventory", "reviews", "payments", "customer_profiles",
    "customer_orders_masked",
)
DELIVERY, DINE_IN, TAKEOUT = "DELIVERY", "DINE_IN", "TAKEOUT"
TOP_K = 10


def _scope(tables: Mapping[str, DataFrame], name: str, locations: Locations, start, end, day="business_date") -> DataFrame:
    return in_scope(tables[name], locations, start, end, day)


def _order_money(*more: Column) -> list[Column]:
    total = F.col("total_amount")
    return [cents(total).alias("revenue"), *more, mean_cents(total).alias("avg_order_value")]


def daily_revenue(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    orders = _scope(tables, "orders_clean", locations, start, end)
    return (
        orders.groupBy(F.col("business_date").alias("date"))
        .agg(F.count_distinct("order_guid").alias("orders"), *_order_money())
        .orderBy("date")
    )


average_order_value = daily_revenue


def sales_summary(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    return _scope(tables, "orders_clean", locations, start, end).agg(
        F.count_distinct("order_guid").alias("orders"),
        *_order_money(),
        cents(F.col("tip_amount")).alias("tips"),
        cents(F.col("discount_amount")).alias("discounts"),
    )


def _item_sums(items: DataFrame, *keys: Column | str, category: bool = True) -> DataFrame:
    measures = [F.min("category").alias("category")] if category else []
    return (
        items.groupBy(*keys)
        .agg(*measures, F.sum("quantity").alias("order_count"), cents(F.col("total_price")).alias("revenue"))
        .withColumn("avg_price", ratio(F.col("revenue"), F.col("order_count")))
    )


def _top_items(tables, locations, start, end, metric: str) -> DataFrame:
    items = _scope(tables, "order_items_clean", locations, start, end)
    return _item_sums(items, F.col("item_name").alias("item")).orderBy(F.desc(metric), "item").limit(TOP_K)


def top_items_by_revenue(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    return _top_items(tables, locations, start, end, "revenue")


def top_items_by_orders(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    return _top_items(tables, locations, start, end, "order_count")


def specific_item_performance(tables, item_name: str, locations: Locations = None, start=None, end=None) -> DataFrame:
    items = _scope(tables, "order_items_clean", locations, start, end).filter(F.col("item_name") == item_name)
    return _item_sums(items, F.col("business_date").alias("date"), F.col("item_name").alias("item")).orderBy("date")


def category_performance(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    items = _scope(tables, "order_items_clean", locations, start, end)
    return _item_sums(items, "category", category=False).orderBy(F.desc("revenue"), "category")


def category_revenue_mix(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    """Share and rank per category. The windows run over one row per category."""
    sums = category_performance(tables, locations, start, end)
    whole = F.sum("revenue").over(Window.partitionBy())
    return sums.select(
        "category",
        "order_count",
        "revenue",
        F.round(100 * ratio(F.col("revenue"), whole), 2).alias("revenue_share_pct"),
        "avg_price",
        F.rank().over(Window.orderBy(F.desc("revenue"))).alias("revenue_rank"),
    ).orderBy("revenue_rank", "category")


def order_type_mix(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    orders = _scope(tables, "orders_clean", locations, start, end)
    return (
        orders.groupBy("order_type")
        .agg(F.count_distinct("order_guid").alias("orders"), *_order_money())
        .orderBy(F.desc("revenue"), "order_type")
    )


def _stock(tables, snapshot_date: str, locations: Locations) -> DataFrame:
    return in_scope(tables["inventory"], locations).filter(F.col("snapshot_date") == snapshot_date)


def _stock_rows(stock: DataFrame, name: str) -> DataFrame:
    return stock.select(
        F.col("item_name").alias(name), "category", F.col("current_stock").alias("stock"), "reorder_level", "status"
    )


def inventory_attention(tables, snapshot_date: str, locations: Locations = None) -> DataFrame:
    low = _stock(tables, snapshot_date, locations).filter(F.col("status").isin("low", "critical"))
    return _stock_rows(low, "item").orderBy("status", "item")


def review_sentiment(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    found = _scope(tables, "reviews", locations, start, end, "review_date")
    return (
        found.groupBy("sentiment")
        .agg(F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("avg_rating"))
        .orderBy(F.desc("review_count"), "sentiment")
    )


def customer_summary(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    """Customers by their orders inside the window."""
    inside = customer_profiles(tables["customer_orders_masked"], tables["orders_clean"], locations, start, end)
    return customer_order_bins(inside)


def _raw_orders(tables, locations, start, end, key: Column, *measures: Column) -> DataFrame:
    return min_group(_scope(tables, "orders", locations, start, end), [key], *measures)


ROWS = "order_count"


def daily_revenue_min_group(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    return _raw_orders(
        tables, locations, start, end, F.col("business_date").alias("date"),
        *_order_money(F.count(F.lit(1)).alias("orders")),
    ).orderBy("date")


def _raw_items(tables, locations, start, end, *keys: Column, price: bool = True, where: Column | None = None) -> DataFrame:
    items = _scope(tables, "order_items", locations, start, end)
    if where is not None:
        items = items.filter(where)
    quantity = [F.sum("quantity").alias("_quantity")] if price else []
    grouped = min_group(
        items, list(keys), F.count(F.lit(1)).alias(ROWS), cents(F.col("total_price")).alias("revenue"), *quantity
    )
    if price:
        grouped = grouped.withColumn("avg_price", ratio(F.col("revenue"), F.col("_quantity"))).drop("_quantity")
    return grouped


ITEM = "item"


def _item_key() -> Column:
    return F.col("item_name").alias(ITEM)


def top_items_with_category(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    rows = _raw_items(tables, locations, start, end, _item_key(), F.col("category"))
    return rows.orderBy(F.desc("revenue"), ITEM, "category").limit(TOP_K)


def weekly_revenue(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    """Weeks start on Sunday; the days before the first Sunday of a year are week 0."""
    day = parse_day(F.col("business_date"))
    week = F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7).cast("string")
    key = F.concat(F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(week, 2, "0")).alias("week")
    revenue = cents(F.col("total_amount")).alias("revenue")
    return _raw_orders(tables, locations, start, end, key, revenue, F.count(F.lit(1)).alias("orders")).orderBy("week")


def monthly_revenue(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    key = F.substring("business_date", 1, 6).alias("month")
    revenue = cents(F.col("total_amount")).alias("revenue")
    return _raw_orders(tables, locations, start, end, key, revenue, F.count(F.lit(1)).alias("orders")).orderBy("month")


def revenue_by_order_type(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    return _raw_orders(
        tables, locations, start, end, F.col("order_type"), *_order_money(F.count(F.lit(1)).alias(ROWS))
    ).orderBy(F.desc("revenue"), "order_type")


def average_metrics(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    orders = _scope(tables, "orders", locations, start, end)

    def one(label: str, column: str) -> DataFrame:
        return orders.agg(mean_cents(F.col(column)).alias("value")).select(F.lit(label).alias("metric"), "value")

    return one("Average Order Value", "total_amount").unionByName(one("Average Tip", "tip_amount"))


def low_inventory(tables, snapshot_date: str, locations: Locations = None) -> DataFrame:
    low = _stock(tables, snapshot_date, locations).filter(F.col("status").isin("low", "critical"))
    return _stock_rows(low, "item_name").orderBy("stock", "item_name")


def full_inventory(tables, snapshot_date: str, locations: Locations = None) -> DataFrame:
    return _stock_rows(_stock(tables, snapshot_date, locations), "item_name").orderBy(F.desc("status"), "item_name")


def delivery_tips(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    return (
        _scope(tables, "orders", locations, start, end)
        .filter(F.col("order_type") == DELIVERY)
        .agg(
            cents(F.col("tip_amount")).alias("total_tips"),
            F.count(F.lit(1)).alias("delivery_orders"),
            mean_cents(F.col("tip_amount")).alias("avg_tip"),
        )
    )


def order_types_per_day(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    kinds = {"delivery": DELIVERY, "dine_in": DINE_IN, "takeout": TAKEOUT}
    return _raw_orders(
        tables, locations, start, end, F.col("business_date").alias("date"),
        F.count(F.lit(1)).alias("total_orders"),
        *[F.count_if(F.col("order_type") == kind).alias(name) for name, kind in kinds.items()],
    ).orderBy("date")


def daily_tax(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    key = F.col("business_date").alias("date")
    return _raw_orders(tables, locations, start, end, key, cents(F.col("tax_amount")).alias("value")).orderBy("date")


def items_by_row_count(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    rows = _raw_items(tables, locations, start, end, _item_key(), F.col("category"), price=False)
    return rows.orderBy(F.desc(ROWS), ITEM, "category").limit(TOP_K)


def items_by_keyword(tables, keyword: str, locations: Locations = None, start=None, end=None) -> DataFrame:
    named = F.lower("item_name").contains(keyword.lower())
    return _raw_items(tables, locations, start, end, _item_key(), where=named).orderBy(F.desc("revenue"), ITEM)


# Variants of one dish are compared by the same query: rows per name that holds the keyword.
item_variants = items_by_keyword


def items_by_name_or_category(tables, keyword: str, locations: Locations = None, start=None, end=None) -> DataFrame:
    word = keyword.lower()
    found = F.lower("item_name").contains(word) | F.lower("category").contains(word)
    rows = _raw_items(tables, locations, start, end, _item_key(), F.col("category"), price=False, where=found)
    return rows.orderBy(F.desc("revenue"), ITEM, "category")


def items_by_group_keyword(tables, keyword: str, locations: Locations = None, start=None, end=None) -> DataFrame:
    word = keyword.lower()
    found = F.lower("item_name").contains(word) | F.lower("category").contains(word)
    return _raw_items(tables, locations, start, end, _item_key(), price=False, where=found).orderBy(F.desc("revenue"), ITEM)


def best_item_on_weekday(tables, day_number: int, locations: Locations = None, start=None, end=None) -> DataFrame:
    """`day_number` is 1 for Sunday to 7 for Saturday."""
    on_day = F.dayofweek(parse_day(F.col("business_date"))) == day_number
    rows = _raw_items(tables, locations, start, end, _item_key(), price=False, where=on_day)
    return rows.orderBy(F.desc("revenue"), ITEM).limit(1)


def revenue_by_weekday(tables, locations: Locations = None, start=None, end=None) -> DataFrame:
    day = parse_day(F.col("business_date"))
    orders = _scope(tables, "orders", locations, start, end)
    return min_group(
        orders,
        [F.date_format(day, "EEEE").alias("day_of_week"), F.dayofweek(day).alias("day_num")],
        cents(F.col("total_amount")).alias("revenue"),
        F.count(F.lit(1)).alias(ROWS),
    ).orderBy("day_num")


QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        daily_revenue, sales_summary, top_items_by_revenue, top_items_by_orders, specific_item_performance,
        category_performance, category_revenue_mix, order_type_mix, inventory_attention, review_sentiment,
        customer_summary, daily_revenue_min_group, top_items_with_category, weekly_revenue, monthly_revenue,
        revenue_by_order_type, average_metrics, low_inventory, full_inventory, delivery_tips, order_types_per_day,
        daily_tax, items_by_row_count, items_by_keyword, items_by_name_or_category, items_by_group_keyword,
        best_item_on_weekday, revenue_by_weekday,
    )
} | {"average_order_value": average_order_value, "item_variants": item_variants}


def ask(name: str, tables: Mapping[str, DataFrame], **parameters) -> DataFrame:
    """A question over permitted tables, without small groups or raw identifiers."""
    answer = QUESTIONS[name](permitted(tables, QUESTION_TABLES), **parameters)
    return guard_output(suppress_small(answer))
