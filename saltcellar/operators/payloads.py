"""Nested order, menu and social payloads to flat rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.functions.columns import clean_text, parse_iso_time, utc_text

NO_KIND = "UNKNOWN"


def _kept(entries: Column) -> Column:
    """Array entries that are not voided; a missing array is empty."""
    return F.filter(F.coalesce(entries, F.array()), lambda e: ~F.coalesce(e["voided"], F.lit(False)))


def _amount_sum(entries: Column, field: str) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda total, e: total + F.coalesce(e[field], F.lit(0.0)))


def _inner(checks: Column, field: str) -> Column:
    return F.flatten(F.filter(F.transform(checks, lambda c: c[field]), lambda a: a.isNotNull()))


def _live(orders: DataFrame) -> DataFrame:
    day = F.coalesce(F.col("businessDate").cast("string"), F.lit(""))
    return (
        orders.filter(~F.coalesce(F.col("voided"), F.lit(False)) & (F.col("guid") != ""))
        .withColumn("business_date", day)
        .withColumn("_checks", _kept(F.col("checks")))
    )


def flatten_orders(orders: DataFrame, location: Column) -> DataFrame:
    """One row per live order, its amounts summed over the live checks in place."""
    checks = F.col("_checks")
    amounts = {
        "total_amount": _amount_sum(checks, "totalAmount"),
        "subtotal": _amount_sum(checks, "amount"),
        "tax_amount": _amount_sum(checks, "taxAmount"),
        "tip_amount": _amount_sum(_inner(checks, "payments"), "tipAmount"),
        "discount_amount": _amount_sum(_inner(checks, "appliedDiscounts"), "discountAmount"),
    }
    return _live(orders).select(
        F.col("guid").alias("order_id"),
        location.alias("location_id"),
        "business_date",
        F.col("guid").alias("order_guid"),
        F.coalesce("openedDate", F.lit("")).alias("order_time"),
        F.coalesce("source", F.lit(NO_KIND)).alias("order_type"),
        *[F.bround(value, 2).alias(name) for name, value in amounts.items()],
    )


def _live_checks(orders: DataFrame, location: Column) -> DataFrame:
    return _live(orders).select(
        F.col("guid").alias("order_guid"),
        location.alias("location_id"),
        "business_date",
        F.explode("_checks").alias("check"),
    )


def flatten_order_items(orders: DataFrame, location: Column) -> DataFrame:
    """One row per live selection of a live check. A quantity of none or zero becomes one."""
    quantity = F.coalesce(F.nullif(F.col("item.quantity"), F.lit(0.0)), F.lit(1.0))
    rows = _live_checks(orders, location).withColumn("item", F.explode(_kept(F.col("check.selections"))))
    return rows.select(
        "order_guid",
        F.coalesce("item.displayName", F.lit("")).alias("item_name"),
        F.coalesce("item.salesCategory.name", F.lit("")).alias("category"),
        quantity.cast("long").alias("quantity"),
        F.coalesce("item.preDiscountPrice", F.lit(0.0)).alias("prediscount_total"),
        F.coalesce("item.price", F.lit(0.0)).alias("total_price"),
        "location_id",
        "business_date",
    )


def flatten_payments(orders: DataFrame, location: Column) -> DataFrame:
    rows = _live_checks(orders, location).withColumn("payment", F.explode("check.payments"))
    return rows.select(
        "order_guid",
        F.coalesce("payment.type", F.lit(NO_KIND)).alias("payment_method"),
        F.bround(F.coalesce("payment.amount", F.lit(0.0)), 2).alias("amount"),
        F.coalesce("payment.paidDate", F.lit("")).alias("payment_date"),
        "location_id",
        "business_date",
    )


def flatten_customers(orders: DataFrame, location: Column) -> DataFrame:
    """Contacts of live checks that have at least one of them."""
    fields = {"customer_email": "email", "customer_phone": "phone", "first_name": "firstName", "last_name": "lastName"}
    contacts = {name: clean_text(F.col(f"check.customer.{field}")) for name, field in fields.items()}
    rows = _live_checks(orders, location).select(
        "order_guid", "location_id", "business_date", *[c.alias(n) for n, c in contacts.items()]
    )
    return rows.filter(F.coalesce(*contacts).isNotNull())


def flatten_menus(menus: DataFrame, location: Column, snapshot_date: str) -> DataFrame:
    """Menu items as stock rows; a payload holds `menus` or is itself one menu."""
    groups = F.coalesce(
        F.flatten(F.filter(F.transform("menus", lambda m: m["menuGroups"]), lambda g: g.isNotNull())),
        F.col("menuGroups"),
    )
    rows = (
        menus.select(location.alias("location_id"), F.explode(groups).alias("group"))
        .select("location_id", F.col("group.name").alias("category"), F.explode("group.menuItems").alias("item"))
        .filter(F.col("item.name") != "")
    )
    return rows.select(
        "location_id",
        F.col("item.name").alias("item_name"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.lit(0.0).alias("current_stock"),
        F.lit(0.0).alias("reorder_level"),
        F.bround(F.coalesce("item.price", F.lit(0.0)), 2).alias("unit_cost"),
        F.lit(snapshot_date).alias("snapshot_date"),
        F.lit("good").alias("status"),
    )


def _field_of_each(entries: Column, name: str) -> Column:
    return F.filter(F.transform(entries, lambda e: e[name]), lambda e: e.isNotNull())


def first_nested(path: str) -> Column:
    """The first value that is not NULL along a dotted path; `[]` walks into an array."""
    value, many = None, False
    for part in path.split("."):
        name, walks = part.removesuffix("[]"), part.endswith("[]")
        if value is None:
            value = F.col(name)
        elif many:
            value = _field_of_each(value, name)
        else:
            value = value[name]
        if walks:
            value, many = (F.flatten(value) if many else value), True
    return F.get(F.filter(value, lambda e: e.isNotNull()), 0) if many else value


def _whole_number(text: Column) -> Column:
    return F.nullif(F.trim(text.cast("string")), F.lit("")).try_cast("long")


def timestamp_normalize(text: Column) -> Column:
    """ISO time text with `Z`, `+hhmm` or `+hh:mm` as UTC text; others give NULL."""
    return utc_text(parse_iso_time(text))


def profile_snapshot(profiles: DataFrame, account_label: Column, run_id: Column, zone: Column | None = None) -> DataFrame:
    """Raw profiles with their `snapshot_at` to snapshot rows."""
    account = clean_text(F.col("id"))
    moment, given = parse_iso_time(F.col("snapshot_at")), clean_text(F.col("snapshot_at"))
    texts = ("username", "name", "biography", "account_type")
    numbers = ("media_count", "followers_count", "follows_count")
    return profiles.filter(account.isNotNull()).select(
        account.alias("account_id"),
        F.coalesce(clean_text(account_label), clean_text(F.col("username")), account).alias("account_label"),
        *[clean_text(F.col(n)).alias(n) for n in texts],
        *[_whole_number(F.col(n)).alias(n) for n in numbers],
        clean_text(F.col("profile_picture_url")).alias("profile_picture_url"),
        (clean_text(zone) if zone is not None else F.lit(None).cast("string")).alias("local_timezone"),
        F.coalesce(utc_text(moment), given).alias("snapshot_at"),
        F.coalesce(F.date_format(moment, "yyyyMMdd"), F.replace(F.substring(given, 1, 10), F.lit("-"), F.lit(""))).alias(
            "snapshot_date"
        ),
        run_id.alias("source_run_id"),
    )


def _media_class() -> Column:
    given = clean_text(F.col("media_type"))
    upper = F.upper(F.coalesce(given, F.lit("")))
    return (
        F.when(F.upper(F.coalesce(clean_text(F.col("media_product_type")), F.lit(""))) == "REELS", "REEL")
        .when(upper.isin("VIDEO", "IMAGE"), upper)
        .when(upper == "CAROUSEL_ALBUM", "CAROUSEL")
        .otherwise(given)
    )


def _child(entry: Column) -> Column:
    moment = parse_iso_time(entry["timestamp"])
    return F.struct(
        clean_text(entry["id"]).alias("id"),
        clean_text(entry["media_type"]).alias("media_type"),
        clean_text(entry["timestamp"]).alias("timestamp"),
        utc_text(moment).alias("posted_at_utc"),
        F.date_format(moment, "yyyyMMdd").alias("posted_date_utc"),
        clean_text(entry["media_url"]).alias("media_url"),
        clean_text(entry["thumbnail_url"]).alias("thumbnail_url"),
    )


def media_snapshots(media: DataFrame, account_id: Column, username: Column, account_label: Column, run_id: Column) -> DataFrame:
    """Raw media items to snapshot rows; counters that are missing stay NULL."""
    moment = parse_iso_time(F.col("timestamp"))
    children = F.transform(
        F.filter(F.coalesce(F.col("children.data"), F.array()), lambda c: c.isNotNull()), _child
    )
    texts = ("permalink", "media_url", "thumbnail_url")
    numbers = ("comments_count", "views", "reach", "saved", "shares", "total_interactions")
    account, user = clean_text(account_id), clean_text(username)
    return media.filter(clean_text(F.col("id")).isNotNull()).select(
        account.alias("account_id"),
        F.coalesce(clean_text(account_label), user, account).alias("account_label"),
        user.alias("username"),
        clean_text(F.col("id")).alias("media_id"),
        clean_text(F.col("caption")).alias("caption"),
        _media_class().alias("media_type"),
        clean_text(F.col("media_product_type")).alias("media_product_type"),
        *[clean_text(F.col(n)).alias(n) for n in texts],
        clean_text(F.col("timestamp")).alias("posted_at_raw"),
        utc_text(moment).alias("posted_at_utc"),
        F.date_format(moment, "yyyyMMdd").alias("posted_date_utc"),
        _whole_number(F.coalesce(F.col("like_count"), F.col("likes"))).alias("likes"),
        *[_whole_number(F.col(n)).alias(n) for n in numbers],
        F.when(F.size(children) > 0, F.to_json(children, {"ignoreNullFields": "false"})).alias("children_json"),
        F.size(children).cast("long").alias("child_count"),
        run_id.alias("source_run_id"),
    )


def insight_value(insights: Column, metric: str) -> Column:
    """The value of a metric: `value`, else the first of `values`; the last entry wins."""
    own = F.transform(
        F.filter(insights, lambda e: e["name"] == metric),
        lambda e: F.coalesce(e["value"], F.get(e["values"], 0)["value"]),
    )
    known = F.filter(own, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.element_at(known, -1))


# Metrics fetched for a media item.
INSIGHT_METRICS = ("reach", "saved", "shares")


def insights_pivot(media: DataFrame, metrics: tuple[str, ...] = INSIGHT_METRICS) -> DataFrame:
    """One column per metric; a metric that is absent keeps the item's own value, if any."""
    columns = {}
    for metric in metrics:
        found = insight_value(F.col("insights"), metric).cast("string")
        columns[metric] = F.coalesce(found, F.col(metric)) if metric in media.columns else found
    return media.withColumns(columns)


def media_window(media: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Items of the UTC days start..end (YYYY-MM-DD), and items without a readable time."""
    moment = parse_iso_time(F.col("timestamp"))
    inside = F.lit(True)
    if start is not None:
        inside = inside & (moment >= F.lit(f"{start} 00:00:00").cast("timestamp"))
    if end is not None:
        after = dt.date.fromisoformat(end) + dt.timedelta(days=1)
        inside = inside & (moment < F.lit(f"{after} 00:00:00").cast("timestamp"))
    return media.filter(moment.isNull() | inside)
