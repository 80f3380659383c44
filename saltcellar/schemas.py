"""Declared tables: column types, required columns, and the nested payload types."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.LongType(), "d": T.DoubleType(), "ts": T.TimestampType()}


def _table(text: str) -> T.StructType:
    """`name:type` words, `!` after the type for a required column."""
    fields = []
    for word in text.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], nullable=not kind.endswith("!")))
    return T.StructType(fields)


# The tables of the warehouse.
TABLES: dict[str, T.StructType] = {
    "orders": _table(
        "order_id:s! location_id:s! business_date:s! order_guid:s! order_time:s order_type:s total_amount:d "
        "subtotal:d tax_amount:d tip_amount:d discount_amount:d created_at:ts"
    ),
    "order_items": _table(
        "order_guid:s! item_name:s category:s quantity:i prediscount_total:d total_price:d location_id:s business_date:s"
    ),
    "payments": _table("order_guid:s! payment_method:s amount:d payment_date:s location_id:s business_date:s"),
    "customer_orders": _table(
        "order_guid:s! location_id:s! business_date:s! customer_email:s customer_phone:s first_name:s last_name:s"
    ),
    "inventory": _table(
        "location_id:s! item_name:s! category:s current_stock:d reorder_level:d unit_cost:d last_ordered:s "
        "snapshot_date:s! status:s"
    ),
    "reviews": _table(
        "review_id:s location_id:s order_guid:s review_date:s rating:i review_text:s sentiment:s category:s"
    ),
    "profile_snapshots": _table(
        "account_id:s! account_label:s username:s name:s biography:s account_type:s media_count:i followers_count:i "
        "follows_count:i profile_picture_url:s local_timezone:s snapshot_at:s! snapshot_date:s! source_run_id:s! created_at:ts"
    ),
    "media_snapshots": _table(
        "account_id:s! account_label:s username:s media_id:s! caption:s media_type:s media_product_type:s permalink:s "
        "media_url:s thumbnail_url:s posted_at_raw:s posted_at_utc:s posted_date_utc:s likes:i comments_count:i views:i "
        "reach:i saved:i shares:i total_interactions:i children_json:s child_count:i source_run_id:s! created_at:ts"
    ),
    "time_entries": _table(
        "location_id:s business_date:s employee_name:s job_title:s clock_in_time:s clock_out_time:s total_hours:d "
        "payable_hours:d regular_hours:d overtime_hours:d cash_tips:d non_cash_tips:d total_gratuity:d total_tips:d "
        "wage:d duration_minutes:i"
    ),
    "import_log": _table(
        "import_id:s! location_id:s business_date:s file_type:s file_name:s rows_imported:i import_timestamp:ts"
    ),
    "menu_canonical_map": _table("item_name:s canonical_name:s display_name:s category:s"),
}


def required(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]


# The nested payloads, with the field names of their sources.
ORDER_PAYLOAD = (
    "guid string, businessDate bigint, openedDate string, source string, voided boolean, "
    "diningOption struct<name:string>, checks array<struct<voided:boolean, totalAmount:double, amount:double, "
    "taxAmount:double, payments:array<struct<type:string, amount:double, tipAmount:double, paidDate:string>>, "
    "appliedDiscounts:array<struct<discountAmount:double>>, selections:array<struct<voided:boolean, "
    "displayName:string, quantity:double, preDiscountPrice:double, price:double, salesCategory:struct<name:string>, "
    "modifiers:array<struct<displayName:string>>>>, customer:struct<email:string, phone:string, firstName:string, "
    "lastName:string>, employee:struct<guid:string>, server:struct<guid:string>>>"
)
MENU_PAYLOAD = (
    "menus array<struct<menuGroups:array<struct<name:string, menuItems:array<struct<name:string, price:double>>>>>>, "
    "menuGroups array<struct<name:string, menuItems:array<struct<name:string, price:double>>>>"
)
MEDIA_PAYLOAD = (
    "id string, account string, caption string, media_type string, media_product_type string, timestamp string, "
    "permalink string, media_url string, thumbnail_url string, like_count string, likes string, "
    "comments_count string, views string, reach string, saved string, shares string, total_interactions string, "
    "insights array<struct<name:string, value:bigint, values:array<struct<value:bigint>>>>, "
    "children struct<data:array<struct<id:string, media_type:string, timestamp:string, media_url:string, "
    "thumbnail_url:string>>>"
)
PROFILE_PAYLOAD = (
    "id string, username string, name string, biography string, account_type string, media_count string, "
    "followers_count string, follows_count string, profile_picture_url string, snapshot_at string"
)
