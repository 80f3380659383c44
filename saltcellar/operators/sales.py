"""Sales, menu, inventory, review and labor reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltcellar.functions.columns import cents, day_text, in_scope, mean_cents, ratio

Locations = Sequence[str] | None
Day = str | dt.date | None

# Channel patterns over the upper-cased order type.
CHANNEL_PATTERNS = {
    "dine_in": "DINE|TABLE|IN STORE|ORDER-AND-PAY",
    "api": "^API$",
    "delivery": "DELIVERY",
    "takeout": "TAKEOUT|TAKE OUT|PICKUP|PICK UP",
}
CHANNEL_LABELS = {"dine_in": "Dine-in-like", "api": "API", "delivery": "Delivery", "takeout": "Takeout"}
# Alert bounds.
TIP_RATE_BOUNDS = (13, 15)
ZERO_TIP_BOUNDS = (25, 18)
OVERTIME_HOURS = 8


def _type_text() -> Column:
    return F.upper(F.coalesce(F.col("order_type"), F.lit("")))


def sales_summary(orders: DataFrame, location_ids: Locations = None, start: Day = None, end: Day = None) -> DataFrame:
    """Sales by day; an order is delivery, dine-in or (neither) takeout by its type text."""
    kind = _type_text()
    return (
        in_scope(orders, location_ids, start, end)
        .groupBy("business_date")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            cents(F.col("total_amount")).alias("revenue"),
            mean_cents(F.col("total_amount")).alias("avg_order_value"),
            cents(F.col("tip_amount")).alias("tips"),
            cents(F.col("discount_amount")).alias("discounts"),
            cents(F.col("tax_amount")).alias("tax_amount"),
            F.count_if(kind.contains("DELIVERY")).alias("delivery_orders"),
            F.count_if(kind.contains("DINE")).alias("dine_in_orders"),
            F.count_if(~kind.contains("DELIVERY") & ~kind.contains("DINE")).alias("takeout_orders"),
        )
        .orderBy("business_date")
        .withColumn("business_date", day_text(F.col("business_date")))
        .withColumnRenamed("business_date", "date")
    )


def sales_by_channel(orders: DataFrame, location_ids: Locations = None, start: Day = None, end: Day = None) -> DataFrame:
    """Sales by day and channel. A type text may fall under several channels."""
    kind = _type_text()
    masks = {name: kind.rlike(pattern) for name, pattern in CHANNEL_PATTERNS.items()}
    neither = ~(masks["dine_in"] | masks["api"] | masks["delivery"] | masks["takeout"])
    no_tip = F.coalesce(F.col("tip_amount"), F.lit(0.0)) == 0
    measures = [
        F.count("order_guid").alias("orders"),
        F.coalesce(cents(F.col("total_amount")), F.lit(0.0)).alias("revenue"),
        F.coalesce(cents(F.col("subtotal")), F.lit(0.0)).alias("subtotal"),
        mean_cents(F.col("total_amount")).alias("avg_order_value"),
        F.coalesce(cents(F.col("tip_amount")), F.lit(0.0)).alias("tips"),
        F.coalesce(cents(F.col("discount_amount")), F.lit(0.0)).alias("discounts"),
        F.coalesce(cents(F.col("tax_amount")), F.lit(0.0)).alias("tax_amount"),
        F.count_if(neither).alias("other_orders"),
    ]
    for name, mask in masks.items():
        measures += [
            F.count_if(mask).alias(f"{name}_orders"),
            F.coalesce(cents(F.when(mask, F.col("subtotal"))), F.lit(0.0)).alias(f"{name}_subtotal"),
            F.coalesce(cents(F.when(mask, F.col("tip_amount"))), F.lit(0.0)).alias(f"{name}_tips"),
            F.count_if(mask & no_tip).alias(f"{name}_zero_tip_orders"),
        ]
    return (
        in_scope(orders, location_ids, start, end)
        .filter(F.col("business_date").isNotNull())
        .groupBy("business_date")
        .agg(*measures)
        .orderBy("business_date")
        .withColumn("business_date", day_text(F.col("business_date")))
        .withColumnRenamed("business_date", "date")
    )


def menu_performance(
    items: DataFrame, inventory: DataFrame, location_ids: Locations = None, start: Day = None, end: Day = None
) -> DataFrame:
    """Rows, revenue and weighted price per raw item name.

    The category comes from the inventory of the item's location. An item with several
    categories there counts once for each. Rows are summed per (item, location) first, so
    only these sums meet the inventory.
    """
    sold = (
        in_scope(items, location_ids, start, end)
        .groupBy("item_name", "location_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("total_price").alias("price"), F.sum("quantity").alias("quantity"))
    )
    kinds = inventory.filter(F.col("category") != "").select("item_name", "location_id", "category").distinct()
    return (
        sold.join(kinds, ["item_name", "location_id"], "left")
        .groupBy(F.col("item_name").alias("item"))
        .agg(
            F.min("category").alias("category"),
            F.sum("rows").alias("order_count"),
            cents(F.col("price")).alias("revenue"),
            F.sum("quantity").alias("_quantity"),
        )
        .withColumn("avg_price", ratio(F.col("revenue"), F.col("_quantity")))
        .drop("_quantity")
        .orderBy(F.desc("revenue"), "item")
    )


def menu_performance_qty(
    clean_items: DataFrame, location_ids: Locations = None, start: Day = None, end: Day = None
) -> DataFrame:
    """Quantity, revenue and plain mean of unit prices per item name."""
    return (
        in_scope(clean_items, location_ids, start, end)
        .filter(F.col("item_name").isNotNull())
        .groupBy(F.col("item_name").alias("item"))
        .agg(
            F.min("category").alias("category"),
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("order_count"),
            F.coalesce(cents(F.col("total_price")), F.lit(0.0)).alias("revenue"),
            F.round(F.avg("true_unit_price"), 6).alias("avg_price"),
        )
        .orderBy(F.desc("revenue"), "item")
    )


def _stock_columns(status: Column) -> list[Column]:
    return [
        F.col("item_name").alias("item"),
        F.col("category"),
        F.col("current_stock").alias("stock"),
        F.col("reorder_level"),
        F.col("unit_cost"),
        F.col("last_ordered"),
        status.alias("status"),
    ]


def inventory_status(inventory: DataFrame, snapshot_date: str, location_ids: Locations = None) -> DataFrame:
    """The stock of one day with a status from the stock itself."""
    status = (
        F.when(F.col("current_stock") <= 0, "critical")
        .when(F.col("current_stock") < F.col("reorder_level"), "low")
        .otherwise("good")
    )
    return (
        in_scope(inventory, location_ids)
        .filter(F.col("snapshot_date") == snapshot_date)
        .select(*_stock_columns(status))
        .orderBy(F.desc("status"), "item")
    )


def inventory_status_latest(inventory: DataFrame, snapshot_date: str, location_ids: Locations = None) -> DataFrame:
    """The stock of the given day, or of the newest day when it has none; stored status."""
    scoped = in_scope(inventory, location_ids)
    wanted = F.max(F.when(F.col("snapshot_date") == snapshot_date, F.col("snapshot_date")))
    day = scoped.agg(F.coalesce(wanted, F.max("snapshot_date"))).scalar()
    return scoped.filter(F.col("snapshot_date") == day).select(*_stock_columns(F.col("status"))).orderBy("status", "item")


def reviews(
    reviews_table: DataFrame,
    location_ids: Locations = None,
    start: Day = None,
    end: Day = None,
    sentiment: str | None = None,
) -> DataFrame:
    found = in_scope(reviews_table, location_ids, start, end, day_column="review_date")
    if sentiment and sentiment != "all":
        found = found.filter(F.col("sentiment") == sentiment)
    return found.orderBy(F.desc("review_date"), "review_id")


def labor_entries(entries: DataFrame, location_ids: Locations = None, start: Day = None, end: Day = None) -> DataFrame:
    return (
        in_scope(entries, location_ids, start, end)
        .select(
            F.col("business_date").alias("date"), "employee_name", "job_title", "clock_in_time", "clock_out_time",
            "total_hours", "payable_hours", "regular_hours", "overtime_hours", "cash_tips", "non_cash_tips",
            "total_gratuity", "total_tips", "wage",
        )
        .orderBy(F.desc("date"), "employee_name", "clock_in_time")
    )


def daily_drivers(daily: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Rows of the daily sales view, all locations."""
    return in_scope(daily, None, start, end).orderBy("business_date", "location_id")


def daily_drivers_raw(orders: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Daily drivers straight from orders: net is the subtotal, refunds count."""
    kind = _type_text()
    return (
        in_scope(orders, None, start, end)
        .filter(F.col("location_id").isNotNull() & F.col("business_date").isNotNull())
        .groupBy("location_id", "business_date")
        .agg(
            F.count("order_guid").alias("order_count"),
            cents(F.col("total_amount")).alias("gross_revenue"),
            cents(F.col("subtotal")).alias("net_revenue"),
            mean_cents(F.col("total_amount")).alias("avg_order_value"),
            cents(F.col("tip_amount")).alias("total_tips"),
            cents(F.col("discount_amount")).alias("total_discounts"),
            F.count_if(kind.contains("DELIVERY")).alias("delivery_orders"),
            F.count_if(kind.contains("DINE")).alias("dine_in_orders"),
            F.count_if(~kind.rlike("DELIVERY|DINE")).alias("takeout_orders"),
        )
        .orderBy("business_date", "location_id")
    )


def weekday_index(orders: DataFrame, location_ids: Locations = None, start: Day = None, end: Day = None) -> DataFrame:
    """Mean daily revenue per weekday over the mean of the weekday means."""
    daily = (
        in_scope(orders, location_ids, start, end)
        .groupBy("business_date")
        .agg(cents(F.col("total_amount")).alias("revenue"))
    )
    by_weekday = daily.groupBy(F.weekday("business_date").alias("weekday")).agg(
        mean_cents(F.col("revenue")).alias("avg_revenue")
    )
    # Seven rows, so the window over all of them is small by construction.
    overall = F.avg("avg_revenue").over(Window.partitionBy())
    names = F.array(*[F.lit(n) for n in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    return (
        by_weekday.withColumn("index", F.round(ratio(F.col("avg_revenue"), overall), 8))
        .orderBy("weekday")
        .select(F.element_at(names, F.col("weekday") + 1).alias("day"), "index", "avg_revenue")
    )


def summary_metrics(summary: DataFrame) -> DataFrame:
    """Totals over the daily summary, order value and tip per order."""
    return summary.agg(
        cents(F.col("revenue")).alias("total_revenue"),
        F.sum("orders").alias("total_orders"),
        cents(F.col("tips")).alias("total_tips"),
    ).select(
        "total_revenue",
        "total_orders",
        F.coalesce(ratio(F.col("total_revenue"), F.col("total_orders")), F.lit(0.0)).alias("avg_order_value"),
        F.coalesce(ratio(F.col("total_tips"), F.col("total_orders")), F.lit(0.0)).alias("avg_tip"),
    )


def week_over_week(summary: DataFrame, days: int = 7) -> DataFrame:
    """Change in percent of the last days with data over the days before; NULL below two weeks."""
    latest = summary.orderBy(F.desc("date")).limit(2 * days)
    recent = F.row_number().over(Window.orderBy(F.desc("date"))) <= days
    marked = latest.withColumn("recent", recent)

    def change(name: str) -> Column:
        new = F.round(F.sum(F.when(F.col("recent"), F.col(name))), 2)
        old = F.round(F.sum(F.when(~F.col("recent"), F.col(name))), 2)
        return F.when(F.count(F.lit(1)) == 2 * days, (ratio(new, old) - 1) * 100)

    return marked.agg(change("revenue").alias("revenue_change_pct"), change("orders").alias("orders_change_pct"))


def tip_breakdown(channel_days: DataFrame) -> DataFrame:
    """Tip share and zero-tip share per channel, over the daily channel table."""
    sums = channel_days.agg(
        *[
            F.round(F.sum(f"{name}_{part}"), 2).alias(f"{name}_{part}")
            for name in CHANNEL_PATTERNS
            for part in ("orders", "subtotal", "tips", "zero_tip_orders")
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(CHANNEL_LABELS[name]).alias("channel"),
                F.coalesce(F.col(f"{name}_orders").cast("long"), F.lit(0)).alias("orders"),
                F.coalesce(F.col(f"{name}_subtotal"), F.lit(0.0)).alias("subtotal"),
                F.coalesce(F.col(f"{name}_tips"), F.lit(0.0)).alias("tips"),
                F.coalesce(F.col(f"{name}_zero_tip_orders").cast("long"), F.lit(0)).alias("zero_tips"),
            )
            for name in CHANNEL_PATTERNS
        ]
    )
    percent = lambda part, whole: F.coalesce(ratio(F.col(part), F.col(whole)), F.lit(0.0)) * 100
    return (
        sums.select(F.explode(rows).alias("row"))
        .select("row.*")
        .filter((F.col("orders") > 0) | (F.col("subtotal") > 0))
        .select(
            "channel",
            "orders",
            percent("tips", "subtotal").alias("tip_pct"),
            percent("zero_tips", "orders").alias("zero_tip_pct"),
            "tips",
        )
    )


def tip_alert(breakdown: DataFrame) -> DataFrame:
    """Alert level of the dine-in channel."""
    error = (F.col("tip_pct") < TIP_RATE_BOUNDS[0]) | (F.col("zero_tip_pct") >= ZERO_TIP_BOUNDS[0])
    warning = (F.col("tip_pct") < TIP_RATE_BOUNDS[1]) | (F.col("zero_tip_pct") >= ZERO_TIP_BOUNDS[1])
    return breakdown.filter(F.col("channel") == CHANNEL_LABELS["dine_in"]).select(
        "channel",
        "tip_pct",
        "zero_tip_pct",
        F.when(error, "error").when(warning, "warning").otherwise("ok").alias("level"),
    )


def inventory_alerts(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status").isin("critical", "low")).select("status", "item").orderBy("status", "item")


def overtime_alerts(labor: DataFrame, hours: float = OVERTIME_HOURS) -> DataFrame:
    """Days whose overtime adds up to more than the bound, largest first."""
    return (
        labor.groupBy("date")
        .agg(F.round(F.sum("overtime_hours"), 2).alias("overtime_hours"))
        .filter(F.col("overtime_hours") > hours)
        .orderBy(F.desc("overtime_hours"), "date")
    )


def top_items(menu: DataFrame, metric: str = "revenue", k: int = 15) -> DataFrame:
    """The k best items by `revenue` or `order_count`."""
    return menu.orderBy(F.desc(metric), "item").limit(k)


def labor_summary(labor: DataFrame) -> DataFrame:
    return labor.agg(
        cents(F.col("payable_hours")).alias("payable_hours"),
        F.count_distinct("employee_name").alias("employees"),
        cents(F.col("total_tips")).alias("total_tips"),
        cents(F.col("overtime_hours")).alias("overtime_hours"),
    )


def labor_daily(labor: DataFrame) -> DataFrame:
    return (
        labor.groupBy("date")
        .agg(*[cents(F.col(c)).alias(c) for c in ("payable_hours", "total_tips", "regular_hours", "overtime_hours")])
        .orderBy("date")
    )


def labor_top_employees(labor: DataFrame, metric: str = "payable_hours", k: int = 10) -> DataFrame:
    return (
        labor.filter(F.col("employee_name").isNotNull())
        .groupBy("employee_name")
        .agg(cents(F.col(metric)).alias(metric))
        .orderBy(F.desc(metric), "employee_name")
        .limit(k)
    )
