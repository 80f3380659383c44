"""Clean views over the raw tables: one row per fact, parsed dates, masked contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltcellar.functions.columns import (
    cents,
    clean_text,
    first_per,
    in_scope,
    mean_cents,
    parse_clock,
    parse_day,
    parse_offset_time,
    ratio,
)

# Text marks of an order's channel and the sentinel of a missing one.
MISSING_MARK = "UNKNOWN"
TAKEOUT_MARKS = ("TAKEOUT", "TAKE OUT", "PICKUP", "PICK UP")
HIGH_TOTAL = 500


def _order_category(order_type: Column) -> Column:
    upper = F.upper(order_type)
    takeout = F.lit(False)
    for mark in TAKEOUT_MARKS:
        takeout = takeout | upper.contains(mark)
    return (
        F.when(upper.contains("DELIVERY"), "Delivery")
        .when(takeout, "Takeout")
        .when(upper.contains("DINE"), "Dine-In")
        .otherwise("Other")
    )


def orders_clean(orders: DataFrame, location_ids: Sequence[str] | None = None) -> DataFrame:
    """One row per order: the earliest copy, with parsed times, category, tip rate, flags."""
    order = [F.col(c) for c in ("created_at", "order_id", "location_id", "business_date", "order_time", "total_amount", "tip_amount")]
    once = in_scope(first_per(orders, ["order_guid"], order), location_ids)
    clock = parse_clock(F.col("order_time"))
    day = parse_day(F.col("business_date"))
    total = F.col("total_amount")
    return once.select(
        "order_id",
        "location_id",
        day.alias("business_date"),
        "order_guid",
        clock.alias("order_time"),
        F.nullif(F.col("order_type"), F.lit(MISSING_MARK)).alias("order_type"),
        _order_category(F.col("order_type")).alias("order_category"),
        "total_amount",
        "subtotal",
        "tax_amount",
        "tip_amount",
        "discount_amount",
        ratio(F.col("tip_amount"), total).alias("tip_rate"),
        F.hour(clock).alias("hour_of_day"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        (total > HIGH_TOTAL).alias("flag_high_total"),
        (total < 0).alias("flag_negative"),
        (total == 0).alias("flag_zero_amount"),
        "created_at",
    )


def _with_names(items: DataFrame, name_map: DataFrame) -> DataFrame:
    """Items with canonical name, display name and category filled from the map.

    The map is one row per item name; it is broadcast only when Spark measures it as small.
    """
    names = name_map.select(
        F.col("item_name").alias("_name"),
        F.col("canonical_name").alias("_canonical"),
        F.col("display_name").alias("_display"),
        F.col("category").alias("_category"),
    )
    own = F.nullif(F.col("item_name"), F.lit(""))
    return items.join(names, F.col("item_name") == F.col("_name"), "left").withColumns(
        {
            "canonical_name": F.coalesce(F.col("_canonical"), own),
            "display_name": F.coalesce(F.col("_display"), own),
            "category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("_category")),
        }
    )


def order_items_clean(
    items: DataFrame, name_map: DataFrame, location_ids: Sequence[str] | None = None
) -> DataFrame:
    """One row per (order, item, quantity), names folded by the map, unit price added."""
    order = [F.col(c) for c in ("prediscount_total", "total_price", "category", "location_id", "business_date")]
    once = in_scope(first_per(items, ["order_guid", "item_name", "quantity"], order), location_ids)
    return _with_names(once, name_map).select(
        "order_guid",
        F.nullif(F.col("item_name"), F.lit("")).alias("item_name"),
        "canonical_name",
        "display_name",
        "category",
        "quantity",
        "prediscount_total",
        "total_price",
        ratio(F.col("total_price"), F.col("quantity")).alias("true_unit_price"),
        "location_id",
        parse_day(F.col("business_date")).alias("business_date"),
    )


def payments_clean(payments: DataFrame, location_ids: Sequence[str] | None = None) -> DataFrame:
    return in_scope(payments, location_ids).select(
        "order_guid",
        F.nullif(F.col("payment_method"), F.lit(MISSING_MARK)).alias("payment_method"),
        "amount",
        parse_clock(F.col("payment_date")).alias("payment_date"),
        "location_id",
        parse_day(F.col("business_date")).alias("business_date"),
    )


def daily_sales(clean_orders: DataFrame, location_ids: Sequence[str] | None = None) -> DataFrame:
    """Sales of each location and day, refunds left out."""
    kind = F.coalesce(F.col("order_category"), F.lit("Other"))
    return (
        in_scope(clean_orders, location_ids)
        .filter(F.col("total_amount") >= 0)
        .groupBy("location_id", "business_date")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            cents(F.col("total_amount")).alias("gross_revenue"),
            cents(F.col("total_amount") - F.col("discount_amount")).alias("net_revenue"),
            mean_cents(F.col("total_amount")).alias("avg_order_value"),
            cents(F.col("tip_amount")).alias("total_tips"),
            cents(F.col("discount_amount")).alias("total_discounts"),
            F.count_if(kind == "Delivery").alias("delivery_orders"),
            F.count_if(kind == "Dine-In").alias("dine_in_orders"),
            F.count_if(~kind.isin("Delivery", "Dine-In")).alias("takeout_orders"),
        )
    )


def item_performance(
    items: DataFrame, name_map: DataFrame, location_ids: Sequence[str] | None = None
) -> DataFrame:
    """Raw item rows (repeats included) by location, folded name, category and day.

    The rows of an order are summed before the distinct count, so each stage sends partial
    aggregates only.
    """
    named = _with_names(in_scope(items, location_ids).filter(F.col("item_name") != ""), name_map)
    keys = ["location_id", "canonical_name", "display_name", "category", "business_date"]
    per_order = named.groupBy(*keys, "order_guid").agg(
        F.sum("quantity").alias("quantity"), F.sum("total_price").alias("price")
    )
    return (
        per_order.groupBy(*keys)
        .agg(
            F.sum("quantity").alias("total_qty"),
            cents(F.col("price")).alias("total_revenue"),
            F.count("order_guid").alias("order_count"),
        )
        .withColumn("avg_unit_price", ratio(F.col("total_revenue"), F.col("total_qty")))
        .withColumn("business_date", parse_day(F.col("business_date")))
    )


def customers_masked(customer_orders: DataFrame, location_ids: Sequence[str] | None = None) -> DataFrame:
    """Contacts replaced by a stable SHA-256 id: e-mail first, else phone digits, else NULL."""
    email, phone = F.trim("customer_email"), F.trim("customer_phone")
    has_email = F.coalesce(email != "", F.lit(False))
    has_phone = F.coalesce(phone != "", F.lit(False))
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return in_scope(customer_orders, location_ids).select(
        "order_guid",
        "location_id",
        parse_day(F.col("business_date")).alias("business_date"),
        F.when(has_email, F.sha2(F.lower(email), 256)).when(has_phone, F.sha2(digits, 256)).alias("customer_id"),
        has_email.alias("has_email"),
        has_phone.alias("has_phone"),
    )


def profiles_current(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each account."""
    newest = first_per(snapshots, ["account_id"], [F.desc("created_at"), F.desc("source_run_id")])
    return newest.withColumns(
        {
            "snapshot_at": parse_offset_time(F.col("snapshot_at")),
            "snapshot_date": parse_day(F.col("snapshot_date")),
        }
    )


def media_current(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each media item, with its time, day and engagement."""
    newest = first_per(snapshots, ["account_id", "media_id"], [F.desc("created_at"), F.desc("source_run_id")])
    zero = F.lit(0)
    return (
        newest.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("caption", "media_type", "media_product_type")})
        .withColumns(
            {
                "posted_at": F.coalesce(
                    parse_offset_time(F.col("posted_at_utc")), parse_offset_time(F.col("posted_at_raw"))
                ),
                "posted_date": parse_day(F.col("posted_date_utc")),
                "engagement_total": F.coalesce(
                    F.col("total_interactions"),
                    F.coalesce(F.col("likes"), zero) + F.coalesce(F.col("comments_count"), zero),
                ),
                "is_carousel": F.upper(F.coalesce(F.col("media_type"), F.lit(""))) == "CAROUSEL",
            }
        )
        .drop("posted_at_utc", "posted_date_utc")
    )


# What is taken out of display names.
CJK_RUN = r"[\x{4e00}-\x{9fff}]+"
PORTION_SUFFIX = r"\s*\(\d+\)\s*"
SYMBOLS = r"[\x{10000}-\x{10ffff}\x{2300}-\x{27ff}\x{2b00}-\x{2bff}]"


def clean_display_name(text: Column) -> Column:
    """Display text without portion suffixes, symbols and double spaces."""
    text = F.regexp_replace(text, PORTION_SUFFIX, " ")
    text = F.regexp_replace(text, SYMBOLS, "")
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def menu_canonical_map(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Item name to canonical name, display name and category.

    Names that hold CJK characters fold to these; their display name is the English part of
    the most frequent variant. The category is the most frequent one in the inventory.
    """
    counted = (
        items.filter(F.col("item_name") != "")
        .groupBy("item_name")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("key", F.array_join(F.regexp_extract_all("item_name", F.lit(f"({CJK_RUN})")), ""))
        .withColumn("english", F.trim(F.regexp_replace("item_name", CJK_RUN, "")))
    )
    # Highest count wins, the smaller name on a tie; min_by is combined on the map side.
    shown = (
        counted.filter(F.col("key") != "")
        .groupBy("key")
        .agg(F.min_by("english", F.struct(-F.col("rows"), F.col("item_name"))).alias("english"))
        .select("key", F.nullif(clean_display_name(F.col("english")), F.lit("")).alias("shown"))
    )
    stocked = (
        inventory.filter(F.col("category") != "")
        .groupBy("item_name", "category")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("item_name")
        .agg(F.min_by("category", F.struct(-F.col("rows"), F.col("category"))).alias("category"))
    )
    folded = F.col("key") != ""
    return (
        counted.join(shown, "key", "left")
        .join(stocked, "item_name", "left")
        .select(
            "item_name",
            F.when(folded, F.col("key")).otherwise(F.col("item_name")).alias("canonical_name"),
            F.when(folded, F.coalesce(F.col("shown"), F.col("key"))).otherwise(F.col("item_name")).alias("display_name"),
            "category",
        )
    )


def locations(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("location_id").isNotNull()).select("location_id").distinct().orderBy("location_id")


def location_labels(orders: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """A label per location: the town of a known address, a demo name, or `Location n`.

    `addresses` has location_id and address. Positions are taken over the distinct locations,
    a table of one row per site.
    """
    sites = orders.filter(F.col("location_id").isNotNull()).select("location_id").distinct()
    position = F.row_number().over(Window.orderBy("location_id"))
    demo = F.initcap(F.replace(F.replace(F.col("location_id"), F.lit("demo_"), F.lit("")), F.lit("_"), F.lit(" ")))
    label = F.when(F.col("location_id").startswith("demo_"), demo).otherwise(
        F.concat(F.lit("Location "), F.col("position").cast("string"))
    )
    numbered = sites.withColumn("position", position)
    if addresses is None:
        return numbered.select("location_id", label.alias("label"))
    parts = F.transform(F.split("address", ","), lambda part: F.trim(part))
    town = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.col("address"))
    towns = addresses.filter(F.col("address") != "").select("location_id", town.alias("town"))
    return numbered.join(towns, "location_id", "left").select(
        "location_id", F.coalesce(F.col("town"), label).alias("label")
    )


def available_dates(orders: DataFrame, location_ids: Sequence[str] | None = None) -> DataFrame:
    return (
        in_scope(orders, location_ids)
        .filter(F.col("business_date").isNotNull())
        .select("business_date")
        .distinct()
        .orderBy(F.desc("business_date"))
    )


def default_date_range(orders: DataFrame, location_ids: Sequence[str] | None = None, days: int = 30) -> DataFrame:
    """From the `days`-th newest day with data (or the oldest) to the newest."""
    newest = available_dates(orders, location_ids).limit(days)
    return newest.agg(F.min("business_date").alias("start_date"), F.max("business_date").alias("end_date"))
