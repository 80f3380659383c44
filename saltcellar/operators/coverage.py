"""Profiles of raw payloads: how much is there and how often fields are filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.functions.columns import clean_text, ratio


def _length(array: Column) -> Column:
    return F.coalesce(F.size(F.coalesce(array, F.array())), F.lit(0))


def _checks(orders: DataFrame) -> DataFrame:
    return orders.select(F.explode("checks").alias("check"))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0)) * 100


def payload_profile(orders: DataFrame) -> DataFrame:
    """Orders, checks, payments and selections in the payloads."""
    inner = lambda field: F.aggregate(
        F.coalesce(F.col("checks"), F.array()), F.lit(0), lambda n, c: n + _length(c[field])
    )
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    return orders.agg(
        F.count(F.lit(1)).alias("orders"),
        total(_length(F.col("checks"))).alias("checks"),
        total(inner("payments")).alias("payments"),
        total(inner("selections")).alias("selections"),
    )


def customer_coverage(orders: DataFrame) -> DataFrame:
    """Checks with a customer, e-mail, phone and name, and distinct e-mails without case."""
    customer = F.col("check.customer")
    email = clean_text(customer["email"])
    named = clean_text(customer["firstName"]).isNotNull() | clean_text(customer["lastName"]).isNotNull()
    return (
        _checks(orders)
        .agg(
            F.count(F.lit(1)).alias("checks"),
            F.count_if(customer.isNotNull()).alias("with_customer"),
            F.count(email).alias("with_email"),
            F.count(clean_text(customer["phone"])).alias("with_phone"),
            F.count_if(named).alias("with_name"),
            F.count_distinct(F.lower(email)).alias("distinct_emails"),
        )
        .withColumn("customer_pct", _percent(F.col("with_customer"), F.col("checks")))
    )


def masked_email_sample(orders: DataFrame, k: int = 3) -> DataFrame:
    """The first few addresses with only their first letter and domain."""
    email = clean_text(F.col("check.customer.email"))
    masked = F.concat(
        F.substring(F.substring_index("email", "@", 1), 1, 1),
        F.lit("***@"),
        F.when(F.col("email").contains("@"), F.regexp_extract("email", "@(.*)$", 1)).otherwise(""),
    )
    emails = _checks(orders).select(email.alias("email")).filter(F.col("email").isNotNull())
    return emails.orderBy("email").limit(k).select(masked.alias("masked_email"))


def modifier_coverage(orders: DataFrame) -> DataFrame:
    """Share of live selections with modifiers."""
    selections = _checks(orders).select(F.explode("check.selections").alias("s")).filter(
        ~F.coalesce(F.col("s.voided"), F.lit(False))
    )
    return selections.agg(
        F.count(F.lit(1)).alias("selections"),
        F.count_if(_length(F.col("s.modifiers")) > 0).alias("with_modifiers"),
    ).withColumn("pct", _percent(F.col("with_modifiers"), F.col("selections")))


def dining_option_coverage(orders: DataFrame) -> DataFrame:
    """Orders with a dining option, and how many names there are."""
    option = F.col("diningOption")
    return orders.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(option.isNotNull()).alias("with_option"),
        F.count_distinct(option["name"]).alias("distinct_names"),
    ).withColumn("pct", _percent(F.col("with_option"), F.col("orders")))


def dining_option_names(orders: DataFrame) -> DataFrame:
    names = orders.select(F.col("diningOption.name").alias("name")).filter(F.col("name").isNotNull())
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("orders")).orderBy("name")


def server_coverage(orders: DataFrame) -> DataFrame:
    """Share of checks with an employee or server."""
    served = F.col("check.employee").isNotNull() | F.col("check.server").isNotNull()
    return (
        _checks(orders)
        .agg(F.count(F.lit(1)).alias("checks"), F.count_if(served).alias("with_server"))
        .withColumn("pct", _percent(F.col("with_server"), F.col("checks")))
    )


def menu_profile(menus: DataFrame) -> DataFrame:
    """Menus, groups and items in menu payloads."""
    each = menus.select(F.explode("menus").alias("menu"))
    items = F.aggregate(
        F.coalesce(F.col("menu.menuGroups"), F.array()), F.lit(0), lambda n, g: n + _length(g["menuItems"])
    )
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    return each.agg(
        F.count(F.lit(1)).alias("menus"),
        total(_length(F.col("menu.menuGroups"))).alias("groups"),
        total(items).alias("items"),
    )
