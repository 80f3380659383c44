"""Customer profiles, segments and distributions over masked ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.functions.columns import cents, in_scope, ratio
from saltcellar.functions.stats import quantiles
from saltcellar.session import settle

# The smallest group shown, visit bins, bins of the spend chart.
MIN_CUSTOMERS = 10
VISIT_BINS = (
    (1, 1, "1 day"),
    (2, 2, "2 days"),
    (3, 4, "3-4 days"),
    (5, 7, "5-7 days"),
    (8, 14, "8-14 days"),
    (15, None, "15+ days"),
)
SPEND_BINS, SPEND_CLIP = 30, 0.95

Locations = Sequence[str] | None


def _visits(masked: DataFrame, orders: DataFrame, location_ids: Locations, start, end) -> DataFrame:
    """Contact rows with the total and day of their order."""
    who = in_scope(masked, location_ids).select("customer_id", "location_id", "order_guid")
    what = in_scope(orders, None, start, end).select("order_guid", "total_amount", "business_date")
    return who.join(what, "order_guid")


def customer_profiles(
    masked: DataFrame, orders: DataFrame, location_ids: Locations = None, start=None, end=None
) -> DataFrame:
    """Visits and spend per customer and location; orders are counted once.

    Days come first: each day's distinct orders add up to the customer's, because an order
    has one day. That keeps one distinct count per stage.
    """
    visits = _visits(masked, orders, location_ids, start, end).filter(F.col("customer_id").isNotNull())
    days = visits.groupBy("customer_id", "location_id", "business_date").agg(
        F.count_distinct("order_guid").alias("orders"),
        F.sum("total_amount").alias("spend"),
        F.count("total_amount").alias("paid"),
    )
    return _per_customer(days, F.sum("orders"))


def customer_profiles_rows(
    masked: DataFrame, orders: DataFrame, location_ids: Locations = None, start=None, end=None
) -> DataFrame:
    """Visits and spend per customer and location; every contact row counts as an order.

    Both sides are limited to the locations here.
    """
    visits = _visits(masked, in_scope(orders, location_ids), location_ids, start, end)
    days = visits.filter(F.col("customer_id").isNotNull()).groupBy("customer_id", "location_id", "business_date").agg(
        F.count("order_guid").alias("orders"),
        F.sum("total_amount").alias("spend"),
        F.count("total_amount").alias("paid"),
    )
    return _per_customer(days, F.sum("orders"))


def _per_customer(days: DataFrame, order_count: Column) -> DataFrame:
    return (
        days.groupBy("customer_id", "location_id")
        .agg(
            order_count.alias("order_count"),
            F.count("business_date").alias("visit_days"),
            cents(F.col("spend")).alias("total_spend"),
            F.sum("paid").alias("_paid"),
            F.min("business_date").alias("first_visit"),
            F.max("business_date").alias("last_visit"),
        )
        .withColumn("avg_order", ratio(F.col("total_spend"), F.col("_paid")))
        .drop("_paid")
    )


def rfm_customers(
    masked: DataFrame, orders: DataFrame, location_ids: Locations = None, start=None, end=None
) -> DataFrame:
    """Each customer's spend, visit days, recency and segment."""
    visits = _visits(masked, in_scope(orders, location_ids), location_ids, start, end)
    per_day = visits.groupBy("customer_id", "business_date").agg(F.sum("total_amount").alias("spend"))
    grouped = settle(
        per_day.groupBy("customer_id").agg(
            cents(F.col("spend")).alias("total_spend"),
            F.count("business_date").alias("visit_days"),
            F.max("business_date").alias("last_visit"),
        )
    )
    # Orders without a contact have their own row above: they still set the newest day.
    newest = grouped.agg(F.max("last_visit")).first()[0]
    people = grouped.filter(F.col("customer_id").isNotNull()).withColumn(
        "recency_days", F.datediff(F.lit(newest), F.col("last_visit"))
    )
    low, high = quantiles(people, "total_spend", [0.25, 0.75])
    recent, stale = quantiles(people, "recency_days", [0.25, 0.75])
    visits_made, spend, recency = F.col("visit_days"), F.col("total_spend"), F.col("recency_days")
    big, near = spend >= F.lit(high), recency <= F.lit(recent)
    segment = (
        F.when((visits_made >= 3) & near & big, "Champions")
        .when((visits_made >= 2) & big, "Loyal high value")
        .when((visits_made == 1) & near, "Rising")
        .when((visits_made == 1) & big, "Big-ticket occasional")
        .when((visits_made >= 2) & (recency > F.lit(stale)), "Cooling off")
        .when((visits_made >= 2) & (spend < F.lit(low)), "Budget regular")
        .otherwise("One-time")
    )
    return people.withColumn("segment", segment)


def rfm_segments(masked: DataFrame, orders: DataFrame, location_ids: Locations = None, start=None, end=None) -> DataFrame:
    """Size, share and means of the recency / frequency / spend segments."""
    people = rfm_customers(masked, orders, location_ids, start, end)
    everyone = people.agg(F.count(F.lit(1))).scalar()
    return (
        people.groupBy("segment")
        .agg(
            F.count("customer_id").alias("n_customers"),
            F.round(F.avg("total_spend"), 6).alias("avg_total_spend"),
            F.avg("visit_days").alias("avg_visits"),
            F.avg("recency_days").alias("avg_recency_days"),
        )
        .withColumn("pct", F.bround(ratio(F.col("n_customers"), everyone) * 100 * 10, 0) / 10)
        .orderBy(F.desc("avg_total_spend"))
    )


def customer_kpis(profiles: DataFrame) -> DataFrame:
    """Headline customer figures; no row when the group is too small to show."""
    return (
        profiles.agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if(F.col("visit_days") > 1).alias("repeat_customers"),
            F.avg("order_count").alias("avg_orders"),
            F.round(F.avg("total_spend"), 6).alias("avg_spend"),
        )
        .filter(F.col("customers") >= MIN_CUSTOMERS)
        .withColumn("repeat_rate", ratio(F.col("repeat_customers"), F.col("customers")))
    )


def visit_histogram(profiles: DataFrame) -> DataFrame:
    """Customers per bin of visit days, empty bins kept."""
    days = F.col("visit_days")
    label = F.lit(None).cast("string")
    for low, high, name in reversed(VISIT_BINS):
        inside = days >= low if high is None else days.between(low, high)
        label = F.when(inside, name).otherwise(label)
    counted = profiles.groupBy(label.alias("visit_days")).agg(F.count(F.lit(1)).alias("n"))
    bins = profiles.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(b[2]) for b in VISIT_BINS])).alias("sort_order", "visit_days")
    )
    return (
        bins.join(counted, "visit_days", "left")
        .select("visit_days", F.coalesce("n", F.lit(0)).alias("customers"), "sort_order")
        .orderBy("sort_order")
    )


def repeat_revenue_share(profiles: DataFrame) -> DataFrame:
    """Revenue of customers with more than one visit day and of the rest."""
    again = F.col("visit_days") > 1
    sums = profiles.agg(
        F.coalesce(cents(F.when(again, F.col("total_spend"))), F.lit(0.0)).alias("again"),
        F.coalesce(cents(F.when(~again, F.col("total_spend"))), F.lit(0.0)).alias("once"),
    )
    rows = F.array(
        F.struct(F.lit("Repeat (>1 visit)").alias("segment"), F.col("again").alias("revenue")),
        F.struct(F.lit("One-Time").alias("segment"), F.col("once").alias("revenue")),
    )
    return sums.select(F.explode(rows).alias("row")).select("row.*")


def spend_histogram(profiles: DataFrame, bins: int = SPEND_BINS, clip: float = SPEND_CLIP) -> DataFrame:
    """Equal-width bins of spend, with spend above the clip quantile put into the last one."""
    spends = settle(profiles.select("total_spend").filter(F.col("total_spend").isNotNull()))
    (top,) = quantiles(spends, "total_spend", [clip])
    low = spends.agg(F.min("total_spend")).first()[0]
    if low is None:
        low, top = 0.0, 0.0
    top = round(top, 6)
    width = (top - low) / bins
    place = F.least(F.floor(F.coalesce(ratio(F.least("total_spend", F.lit(top)) - low, F.lit(width)), F.lit(0.0))), F.lit(bins - 1))
    return (
        spends.groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("customers"))
        .select(
            "bin",
            F.round(F.lit(low) + F.col("bin") * F.lit(width), 6).alias("bin_start"),
            F.round(F.lit(low) + (F.col("bin") + 1) * F.lit(width), 6).alias("bin_end"),
            "customers",
        )
        .orderBy("bin")
    )


def customer_order_bins(profiles: DataFrame) -> DataFrame:
    """Customers with one, two to four, and five or more orders."""
    count = F.col("order_count")
    segment = F.when(count >= 5, "5+ orders").when(count >= 2, "2-4 orders").otherwise("1 order")
    return (
        profiles.groupBy(segment.alias("customer_segment"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.round(F.avg("total_spend"), 6).alias("avg_total_spend"),
            F.round(F.avg("avg_order"), 6).alias("avg_order_value"),
        )
        .orderBy(F.desc("customers"), "customer_segment")
    )
