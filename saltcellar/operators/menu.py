"""Menu margins, quadrants, recommended actions, basket pairs and promotion signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.functions.columns import in_scope, ratio
from saltcellar.functions.stats import quantiles
from saltcellar.session import at_hand, settle, shuffles_dropped

# Categories of drinks, actions in their order, rule bounds.
DRINK_CATEGORIES = ("BEVERAGES", "ALCOHOL", "DRINKS", "BEER", "WINE", "SPIRITS", "COCKTAILS")
ACTIONS = ("Promote", "Bundle", "Re-price", "Rework", "Remove")
PRICE_ACTIONS = ("Re-price", "Rework", "Remove")
REWORK_REVENUE = 5000
HIGH_CONFIDENCE_ORDERS, MEDIUM_CONFIDENCE_ORDERS, HIGH_CONFIDENCE_COVERAGE = 100, 25, 0.5
FALLBACK_MARGIN = 0.62
MIN_PAIR_COUNT, MIN_LIFT, TOP_PAIRS = 50, 1.2, 100
MIN_STORE_DAYS, MIN_DISCOUNT_DAYS, MIN_PRICES = 10, 5, 3

ORDER_KEYS = ["order_guid", "location_id", "business_date"]
# A basket is expanded in runs of this many leading items, so a very large one is shared
# between tasks.
LEADS_PER_RUN = 64

RECOMMENDATION_COLUMNS = [
    "canonical_name", "display_name", "category", "quadrant", "popularity", "net_revenue", "total_qty",
    "orders_with_item", "avg_unit_price", "avg_net_rev_per_unit", "avg_est_margin_per_unit", "est_margin_pct",
    "discount_rate", "cost_coverage", "margin_source", "recommended_action", "confidence",
]


def in_share(share: int, shares: int) -> Column:
    """Whether a row's order belongs to a share of all orders, by hash of its guid."""
    return F.pmod(F.xxhash64("order_guid"), F.lit(shares)) == share


def matched_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders that have items: keys, discount, and the line revenue of the whole order.

    Line revenue is summed per order before it meets the orders, so an order with very many
    lines is combined on the map side and no window gathers its rows.
    """
    placed = orders.groupBy(*ORDER_KEYS).agg(F.coalesce(F.min("discount_amount"), F.lit(0.0)).alias("discount_amount"))
    revenue = items.groupBy(*ORDER_KEYS).agg(F.sum("total_price").alias("_revenue"))
    matched = placed.join(revenue, ORDER_KEYS)
    whole = matched.groupBy("order_guid").agg(F.round(F.sum("_revenue"), 2).alias("order_revenue"))
    return matched.drop("_revenue").join(whole, "order_guid")


def item_gold(
    clean_items: DataFrame,
    clean_orders: DataFrame,
    inventory: DataFrame,
    location_ids: Sequence[str] | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Item lines with their share of the order discount, cost and margin. Costs come to the lines while they are few, by their counted rows."""
    items = in_scope(clean_items, location_ids, start, end)
    orders = in_scope(clean_orders, location_ids, start, end)
    costs = (
        inventory.filter(F.col("item_name").isNotNull())
        .groupBy("location_id", "item_name")
        .agg(F.round(F.avg("unit_cost"), 6).alias("unit_cost"), F.min("category").alias("category_inventory"))
    )
    price = F.coalesce(F.col("total_price"), F.lit(0.0))
    gold = items.join(matched_orders(items, orders), ORDER_KEYS).join(at_hand(costs), ["location_id", "item_name"], "left")
    share = F.when(
        F.col("order_revenue") > 0, ratio(F.col("discount_amount") * price, F.col("order_revenue"))
    ).otherwise(0.0)
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("category_inventory"), F.lit("UNKNOWN"))
    return (
        gold.withColumn("unit_price", F.col("true_unit_price"))
        .withColumn("alloc_discount", share)
        .withColumn("net_line_revenue", price - F.col("alloc_discount"))
        .withColumn("category_filled", category)
        .withColumn("est_cogs", F.coalesce(F.col("quantity"), F.lit(0)) * F.coalesce(F.col("unit_cost"), F.lit(0.0)))
        .withColumn("est_margin", F.when(F.col("unit_cost").isNotNull(), F.col("net_line_revenue") - F.col("est_cogs")))
        .withColumn("is_discounted", F.col("discount_amount") > 0)
        .withColumn("is_drink", F.upper("category_filled").isin(*DRINK_CATEGORIES))
    )


def _quadrant(popularity: float | None, margin: float | None, axis: str) -> Column:
    popular = F.col("popularity") >= F.lit(popularity)
    profitable = F.col(axis) >= F.lit(margin)
    return (
        F.when(popular & profitable, "Star")
        .when(popular & ~profitable, "Plowhorse")
        .when(~popular & profitable, "Puzzle")
        .otherwise("Dog")
    )


def item_kpis(
    clean_items: DataFrame,
    clean_orders: DataFrame,
    inventory: DataFrame,
    location_ids: Sequence[str] | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Key figures and quadrant per canonical item, from the clean tables."""
    return kpis_of_gold(item_gold(clean_items, clean_orders, inventory, location_ids, start, end))


def _item_sums(gold: DataFrame) -> DataFrame:
    """Sums per canonical item that add up over shares of the orders. Lines are first combined per (item, order), which spreads one very
    popular item over its orders."""
    costed = F.col("unit_cost").isNotNull()
    per_order = (
        gold.filter(F.col("canonical_name").isNotNull())
        .groupBy("canonical_name", "order_guid")
        .agg(
            F.min("display_name").alias("display_name"),
            F.min("category_filled").alias("category"),
            F.sum("quantity").alias("qty"),
            F.sum("net_line_revenue").alias("net"),
            F.sum("unit_price").alias("price_sum"),
            F.count("unit_price").alias("price_count"),
            F.sum("est_margin").alias("margin"),
            F.sum(F.when(costed, F.col("quantity"))).alias("cost_qty"),
            F.sum("alloc_discount").alias("discount"),
        )
    )
    return per_order.groupBy("canonical_name").agg(
        F.min("display_name").alias("display_name"),
        F.min("category").alias("category"),
        F.count("order_guid").alias("orders"),
        *[F.sum(c).alias(c) for c in ("qty", "net", "price_sum", "price_count", "margin", "cost_qty", "discount")],
    )


def kpis_of_gold(gold: DataFrame, shares: int = 1) -> DataFrame:
    """Key figures and quadrant per canonical item; `gold` is read twice a share and should be stored.

    Sums are taken of one share of the orders after another, whose shuffles go before the next; the per-item table is settled because
    medians and rows both read it.
    """
    total_orders, found = 0, None
    for share in range(shares):
        some = gold if shares == 1 else gold.filter(in_share(share, shares))
        with shuffles_dropped(gold.sparkSession):
            total_orders += some.agg(F.count_distinct("order_guid")).scalar()
        summed = settle(_item_sums(some))
        found = summed if found is None else found.union(summed)
    sums = found.groupBy("canonical_name").agg(
        F.min("display_name").alias("display_name"),
        F.min("category").alias("category"),
        F.coalesce(F.sum("qty"), F.lit(0)).alias("total_qty"),
        F.sum("orders").alias("orders_with_item"),
        F.round(F.sum("net"), 2).alias("net_revenue"),
        F.round(ratio(F.sum("price_sum"), F.sum("price_count")), 6).alias("avg_unit_price"),
        F.round(F.sum("margin"), 2).alias("_margin"),
        F.coalesce(F.sum("cost_qty"), F.lit(0)).alias("cost_qty"),
        F.round(F.sum("discount"), 2).alias("discount_dollars"),
    )
    table = settle(
        sums.withColumns(
            {
                "est_margin": F.coalesce(F.col("_margin"), F.lit(0.0)),
                "avg_net_rev_per_unit": F.round(ratio(F.col("net_revenue"), F.col("total_qty")), 6),
                "avg_est_margin_per_unit": F.round(ratio(F.col("_margin"), F.col("total_qty")), 6),
                "popularity": F.coalesce(ratio(F.col("orders_with_item"), total_orders), F.lit(0.0)),
                "cost_coverage": ratio(F.col("cost_qty"), F.col("total_qty")),
            }
        )
        .withColumns(
            {
                "est_margin_pct": F.round(ratio(F.col("est_margin"), F.col("net_revenue")), 6),
                "discount_rate": F.round(
                    ratio(F.col("discount_dollars"), F.col("net_revenue") + F.col("discount_dollars")), 6
                ),
                "margin_axis": F.coalesce(F.col("avg_est_margin_per_unit"), F.col("avg_net_rev_per_unit")),
                "margin_source": F.when(
                    F.coalesce(F.col("cost_coverage"), F.lit(0.0)) > 0, "Inventory cost"
                ).otherwise("Revenue/unit proxy"),
            }
        )
        .drop("_margin")
    )
    (popularity,) = quantiles(table, "popularity", [0.5])
    (margin,) = quantiles(table, "margin_axis", [0.5])
    return table.withColumn("quadrant", _quadrant(popularity, margin, "margin_axis")).orderBy(
        F.desc("net_revenue"), "canonical_name"
    )


def menu_engineering(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        F.col("display_name").alias("item"),
        "category",
        F.col("orders_with_item").alias("order_count"),
        F.col("net_revenue").alias("revenue"),
        F.col("avg_unit_price").alias("avg_price"),
        "quadrant",
    ).orderBy(F.desc("revenue"), "item")


def recommended_action(quadrant: Column, net_revenue: Column, has_bundle: Column | None = None) -> Column:
    """The action for a quadrant; a bundle signal turns Puzzle and Dog into Bundle."""
    bundled = F.lit(False) if has_bundle is None else F.coalesce(has_bundle, F.lit(False))
    return (
        F.when(quadrant == "Star", "Promote")
        .when(quadrant == "Plowhorse", "Re-price")
        .when(bundled, "Bundle")
        .when(quadrant == "Puzzle", "Promote")
        .when(F.coalesce(net_revenue, F.lit(0.0)) >= REWORK_REVENUE, "Rework")
        .otherwise("Remove")
    )


def confidence(orders_with_item: Column, cost_coverage: Column) -> Column:
    covered = F.coalesce(cost_coverage, F.lit(0.0)) >= HIGH_CONFIDENCE_COVERAGE
    return (
        F.when((orders_with_item >= HIGH_CONFIDENCE_ORDERS) & covered, "High")
        .when(orders_with_item >= MEDIUM_CONFIDENCE_ORDERS, "Medium")
        .otherwise("Low")
    )


def menu_recommendations(kpis: DataFrame) -> DataFrame:
    return (
        kpis.withColumn("recommended_action", recommended_action(F.col("quadrant"), F.col("net_revenue")))
        .withColumn("confidence", confidence(F.col("orders_with_item"), F.col("cost_coverage")))
        .select(*RECOMMENDATION_COLUMNS)
        .orderBy(F.desc("net_revenue"), "canonical_name")
    )


def bundle_actions(kpis: DataFrame, pairs: DataFrame) -> DataFrame:
    """Actions when the items of the basket pairs carry the bundle signal."""
    paired = pairs.select(F.explode(F.array("item_a", "item_b")).alias("canonical_name")).distinct()
    signal = F.col("_paired").isNotNull()
    return (
        kpis.join(paired.withColumn("_paired", F.lit(True)), "canonical_name", "left")
        .select(
            "canonical_name",
            "quadrant",
            "net_revenue",
            signal.alias("has_bundle"),
            recommended_action(F.col("quadrant"), F.col("net_revenue"), signal).alias("recommended_action"),
        )
    )


def recommendations_from_menu(menu: DataFrame) -> DataFrame:
    """Recommendations from item sales alone, with a flat margin."""
    table = settle(
        menu.select(
            F.col("item").alias("canonical_name"),
            F.col("item").alias("display_name"),
            "category",
            F.col("revenue").alias("net_revenue"),
            F.col("order_count").alias("total_qty"),
            F.col("order_count").alias("orders_with_item"),
            F.col("avg_price").alias("avg_unit_price"),
            F.round(ratio(F.col("revenue"), F.col("order_count")), 6).alias("avg_net_rev_per_unit"),
        )
    )
    all_orders = table.agg(F.sum("orders_with_item")).first()[0] or 0
    rated = table.withColumns(
        {
            "popularity": F.coalesce(ratio(F.col("orders_with_item"), F.lit(all_orders)), F.lit(0.0)),
            "avg_est_margin_per_unit": F.round(F.col("avg_net_rev_per_unit") * FALLBACK_MARGIN, 6),
            "est_margin_pct": F.lit(FALLBACK_MARGIN),
            "discount_rate": F.lit(0.0),
            "cost_coverage": F.lit(1.0),
            "margin_source": F.lit("Synthetic cost proxy"),
        }
    )
    (popularity,) = quantiles(rated, "popularity", [0.5])
    (margin,) = quantiles(rated, "avg_est_margin_per_unit", [0.5])
    return menu_recommendations(rated.withColumn("quadrant", _quadrant(popularity, margin, "avg_est_margin_per_unit")))


def bundle_pairs(
    gold: DataFrame, min_count: int = MIN_PAIR_COUNT, min_lift: float = MIN_LIFT, k: int = TOP_PAIRS
) -> DataFrame:
    """Pairs of items bought together, with support, confidence and lift.

    A pair can reach `min_count` only if both its items do, so rarer items are left out
    before any pair is formed. Equal baskets are counted once with their number of orders,
    which folds repeated orders, and a long basket is cut into runs of leading items that go
    to different tasks. All of this is exact. `gold` is scanned three times and should be stored.
    """
    named = gold.filter(F.col("canonical_name").isNotNull())
    bought = named.groupBy("order_guid", "canonical_name").agg(
        F.min("display_name").alias("display"),
        F.min("category_filled").alias("category"),
        F.max("is_drink").alias("drink"),
    )
    total = named.agg(F.count_distinct("order_guid")).first()[0]
    items = settle(
        bought.groupBy("canonical_name")
        .agg(
            F.min("display").alias("display"),
            F.min("category").alias("category"),
            F.max("drink").alias("drink"),
            F.count("order_guid").alias("orders"),
        )
        .filter(F.col("orders") >= min_count)
    )
    baskets = (
        named.select("order_guid", "canonical_name")
        .join(items.select("canonical_name"), "canonical_name", "left_semi")
        .groupBy("order_guid")
        .agg(F.sort_array(F.collect_set("canonical_name")).alias("basket"))
        .filter(F.size("basket") >= 2)
    )
    equal = baskets.groupBy(F.xxhash64("basket").alias("hash"), "basket").agg(F.count(F.lit(1)).alias("orders"))
    leads = F.sequence(F.lit(1), F.size("basket") - 1, F.lit(LEADS_PER_RUN))
    # Runs of one long basket are dealt out by their place in it.
    runs = equal.select("basket", "orders", F.explode(leads).alias("run")).repartition("run", F.xxhash64("basket"))
    last = F.least(F.col("run") + (LEADS_PER_RUN - 1), F.size("basket") - 1)
    pairs = (
        runs.select("basket", "orders", F.explode(F.sequence(F.col("run"), last)).alias("lead"))
        .select(
            F.element_at("basket", F.col("lead")).alias("item_a"),
            F.explode(F.slice("basket", F.col("lead") + 1, F.size("basket"))).alias("item_b"),
            "orders",
        )
        .groupBy("item_a", "item_b")
        .agg(F.sum("orders").alias("pair_count"))
        .filter(F.col("pair_count") >= min_count)
    )

    def side(letter: str) -> DataFrame:
        return items.select(
            F.col("canonical_name").alias(f"item_{letter}"),
            F.col("display").alias(f"display_{letter}"),
            F.col("category").alias(f"category_{letter}"),
            F.col("drink").alias(f"_drink_{letter}"),
            F.col("orders").alias(f"orders_{letter}"),
        )

    whole = F.lit(total)
    both, either = F.col("_drink_a") & F.col("_drink_b"), F.col("_drink_a") | F.col("_drink_b")
    return (
        pairs.join(side("a"), "item_a")
        .join(side("b"), "item_b")
        .withColumn("pair_type", F.when(both, "DRINK+DRINK").when(either, "FOOD+DRINK").otherwise("FOOD+FOOD"))
        .withColumn("support", ratio(F.col("pair_count"), whole))
        .withColumn("confidence_b_given_a", ratio(F.col("pair_count"), F.col("orders_a")))
        .withColumn("confidence_a_given_b", ratio(F.col("pair_count"), F.col("orders_b")))
        .withColumn("lift", ratio(F.col("support"), ratio(F.col("orders_a"), whole) * ratio(F.col("orders_b"), whole)))
        .filter(F.col("lift") >= min_lift)
        .select(
            "item_a", "item_b", "display_a", "display_b", "category_a", "category_b", "pair_type", "pair_count",
            "support", "orders_a", "orders_b", "confidence_b_given_a", "confidence_a_given_b",
            F.round("lift", 8).alias("lift"),
        )
        .orderBy(F.desc("lift"), F.desc("pair_count"), "item_a", "item_b")
        .limit(k)
    )


def promo_opportunities(gold: DataFrame, min_store_days: int = MIN_STORE_DAYS) -> DataFrame:
    """Quantity on days with and without discount, and price variation, per item."""
    daily = (
        gold.filter(F.col("canonical_name").isNotNull())
        .groupBy("canonical_name", "display_name", "category_filled", "location_id", "business_date")
        .agg(
            F.sum("quantity").alias("qty"),
            F.avg("unit_price").alias("price"),
            F.max("is_discounted").alias("discounted"),
        )
    )
    discounted = F.col("discounted")
    # Prices are told apart to the cent, half to even, as whole numbers of cents.
    whole_cents = F.bround(F.col("price") * 100, 0)
    table = (
        daily.groupBy("canonical_name")
        .agg(
            F.min("display_name").alias("display_name"),
            F.min("category_filled").alias("category"),
            F.count(F.lit(1)).alias("store_days"),
            F.count_if(discounted).alias("discount_days"),
            F.avg(F.when(discounted, F.col("qty"))).alias("avg_qty_discounted_days"),
            F.avg(F.when(~discounted, F.col("qty"))).alias("avg_qty_regular_days"),
            F.count_distinct(whole_cents).alias("unique_prices"),
            F.round(F.min("price"), 6).alias("min_price"),
            F.round(F.max("price"), 6).alias("max_price"),
        )
        .filter(F.col("store_days") >= min_store_days)
        .withColumn("qty_lift_on_discount_days", F.col("avg_qty_discounted_days") - F.col("avg_qty_regular_days"))
        .withColumn("price_range", F.round(F.col("max_price") - F.col("min_price"), 6))
    )
    raised = (F.col("discount_days") >= MIN_DISCOUNT_DAYS) & (F.col("qty_lift_on_discount_days") > 0)
    kind = F.when(raised, "Promo candidate").when(
        F.col("unique_prices") >= MIN_PRICES, "Review price variation"
    ).otherwise("Monitor")
    priority = F.when(F.col("opportunity_type") == "Promo candidate", 0).when(
        F.col("opportunity_type") == "Review price variation", 1
    ).otherwise(2)
    return table.withColumn("opportunity_type", kind).orderBy(
        priority, F.desc("qty_lift_on_discount_days"), F.desc("price_range"), "canonical_name"
    )


def price_margin_candidates(recommendations: DataFrame) -> DataFrame:
    return recommendations.filter(F.col("recommended_action").isin(*PRICE_ACTIONS)).orderBy(
        "recommended_action", F.desc("net_revenue"), "canonical_name"
    )


def action_counts(recommendations: DataFrame) -> DataFrame:
    """Items per action in the fixed order, zero where none has it."""
    spark = recommendations.sparkSession
    actions = spark.range(1).select(F.posexplode(F.array(*[F.lit(a) for a in ACTIONS])).alias("place", "action"))
    counted = recommendations.groupBy(F.col("recommended_action").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return (
        actions.join(counted, "action", "left")
        .orderBy("place")
        .select("action", F.coalesce("n", F.lit(0)).alias("items"))
    )
