"""Menu and customer reports over the sample tables, with the SQL that checks them."""

from pyspark.sql import functions as F

from saltcellar.operators import customers, menu, sales

# Lower bounds than the defaults: the sample has few pairs that stand out.
PAIR_BOUNDS = {"min_count": 20, "min_lift": 0.9}

QUERIES = {
    "item_gold": lambda t: t.gold.select(
        "order_guid", "item_name", "canonical_name", "location_id", "business_date", "quantity", "order_revenue",
        F.round("alloc_discount", 6).alias("alloc_discount"), F.round("net_line_revenue", 6).alias("net_line_revenue"),
        "unit_cost", "category_filled", F.round("est_cogs", 6).alias("est_cogs"), F.round("est_margin", 6).alias("est_margin"),
        "is_discounted", "is_drink",
    ),
    "item_kpis": lambda t: t.kpis,
    "menu_engineering": lambda t: menu.menu_engineering(t.kpis),
    "menu_recommendations": lambda t: menu.menu_recommendations(t.kpis),
    "bundle_action": lambda t: menu.bundle_actions(t.kpis, menu.bundle_pairs(t.stored_gold, **PAIR_BOUNDS)),
    "recommendations_from_menu": lambda t: menu.recommendations_from_menu(sales.menu_performance(t.raw_items, t.inventory)),
    "bundle_pairs": lambda t: menu.bundle_pairs(t.stored_gold, **PAIR_BOUNDS),
    "promo_opportunities": lambda t: menu.promo_opportunities(t.stored_gold),
    "price_margin_candidates": lambda t: menu.price_margin_candidates(menu.menu_recommendations(t.kpis)),
    "action_counts": lambda t: menu.action_counts(menu.menu_recommendations(t.kpis)),
    "customer_profiles": lambda t: t.profiles,
    "customer_profiles_rows": lambda t: customers.customer_profiles_rows(t.stored_masked, t.stored_orders),
    "rfm_segments": lambda t: customers.rfm_segments(t.stored_masked, t.stored_orders),
    "customer_kpis": lambda t: customers.customer_kpis(t.profiles),
    "visit_histogram": lambda t: customers.visit_histogram(t.profiles),
    "repeat_revenue_share": lambda t: customers.repeat_revenue_share(t.profiles),
    "spend_histogram": lambda t: customers.spend_histogram(t.profiles),
    "customer_order_bins": lambda t: customers.customer_order_bins(t.profiles),
}

_ACTION = """CASE quadrant WHEN 'Star' THEN 'Promote' WHEN 'Puzzle' THEN 'Promote' WHEN 'Plowhorse' THEN 'Re-price'
             ELSE CASE WHEN net_revenue >= 5000 THEN 'Rework' ELSE 'Remove' END END"""


def _quadrant(axis: str) -> str:
    return f"""CASE WHEN popularity >= pop_mid AND {axis} >= margin_mid THEN 'Star' WHEN popularity >= pop_mid AND {axis} < margin_mid THEN 'Plowhorse'
               WHEN popularity < pop_mid AND {axis} >= margin_mid THEN 'Puzzle' ELSE 'Dog' END"""


BLOCKS = {
    "m_orders": """
        SELECT order_guid, location_id, business_date, coalesce(min(discount_amount), 0) AS discount_amount
        FROM v_orders GROUP BY ALL""",
    "m_costs": """
        SELECT location_id, item_name, round(avg(unit_cost), 6) AS unit_cost, min(category) AS category_inventory
        FROM raw_inventory GROUP BY ALL""",
    "m_gold": """
        SELECT *, coalesce(total_price, 0) - alloc_discount AS net_line_revenue,
               quantity * coalesce(unit_cost, 0) AS est_cogs,
               CASE WHEN unit_cost IS NOT NULL THEN coalesce(total_price, 0) - alloc_discount - quantity * unit_cost END AS est_margin,
               discount_amount > 0 AS is_discounted,
               upper(category_filled) IN ('BEVERAGES', 'ALCOHOL', 'DRINKS', 'BEER', 'WINE', 'SPIRITS', 'COCKTAILS') AS is_drink
        FROM (
            SELECT i.*, o.discount_amount, c.unit_cost,
                   round(sum(i.total_price) OVER (PARTITION BY i.order_guid), 2) AS order_revenue,
                   CASE WHEN round(sum(i.total_price) OVER (PARTITION BY i.order_guid), 2) > 0
                        THEN o.discount_amount * i.total_price / round(sum(i.total_price) OVER (PARTITION BY i.order_guid), 2) ELSE 0 END AS alloc_discount,
                   coalesce(nullif(i.category, ''), c.category_inventory, 'UNKNOWN') AS category_filled
            FROM v_items i JOIN m_orders o ON i.order_guid = o.order_guid AND i.location_id = o.location_id AND i.business_date = o.business_date
            LEFT JOIN m_costs c ON i.location_id = c.location_id AND i.item_name = c.item_name)""",
    "m_sums": """
        SELECT canonical_name, min(display_name) AS display_name, min(category_filled) AS category, CAST(sum(quantity) AS BIGINT) AS total_qty,
               count(DISTINCT order_guid) AS orders_with_item, round(sum(net_line_revenue), 2) AS net_revenue,
               round(avg(true_unit_price), 6) AS avg_unit_price, round(sum(est_margin), 2) AS margin,
               coalesce(CAST(sum(quantity) FILTER (unit_cost IS NOT NULL) AS BIGINT), 0) AS cost_qty,
               round(sum(alloc_discount), 2) AS discount_dollars
        FROM m_gold WHERE canonical_name IS NOT NULL GROUP BY canonical_name""",
    "m_rated": """
        SELECT * EXCLUDE (margin), coalesce(margin, 0) AS est_margin, round(net_revenue / nullif(total_qty, 0), 6) AS avg_net_rev_per_unit,
               round(margin / nullif(total_qty, 0), 6) AS avg_est_margin_per_unit,
               orders_with_item / (SELECT count(DISTINCT order_guid) FROM m_gold) AS popularity, cost_qty / nullif(total_qty, 0) AS cost_coverage,
               round(coalesce(margin, 0) / nullif(net_revenue, 0), 6) AS est_margin_pct,
               round(discount_dollars / nullif(net_revenue + discount_dollars, 0), 6) AS discount_rate,
               coalesce(round(margin / nullif(total_qty, 0), 6), round(net_revenue / nullif(total_qty, 0), 6)) AS margin_axis,
               CASE WHEN cost_qty > 0 AND total_qty > 0 THEN 'Inventory cost' ELSE 'Revenue/unit proxy' END AS margin_source
        FROM m_sums""",
    "m_kpis": f"""
        SELECT *, {_quadrant('margin_axis')} AS quadrant
        FROM m_rated, (SELECT median(popularity) AS pop_mid, median(margin_axis) AS margin_mid FROM m_rated)""",
    "m_recs": f"""
        SELECT canonical_name, display_name, category, quadrant, popularity, net_revenue, total_qty, orders_with_item, avg_unit_price,
               avg_net_rev_per_unit, avg_est_margin_per_unit, est_margin_pct, discount_rate, cost_coverage, margin_source,
               {_ACTION} AS recommended_action,
               CASE WHEN orders_with_item >= 100 AND coalesce(cost_coverage, 0) >= 0.5 THEN 'High' WHEN orders_with_item >= 25 THEN 'Medium' ELSE 'Low' END AS confidence
        FROM m_kpis""",
    "m_bought": "SELECT order_guid, canonical_name, min(display_name) AS display, min(category_filled) AS category, max(is_drink) AS drink FROM m_gold WHERE canonical_name IS NOT NULL GROUP BY ALL",
    "m_support": "SELECT canonical_name, min(display) AS display, min(category) AS category, max(drink) AS drink, count(*) AS orders, (SELECT count(DISTINCT order_guid) FROM m_bought) AS total FROM m_bought GROUP BY canonical_name",
    "m_pairs": """
        SELECT item_a, item_b, a.display AS display_a, b.display AS display_b, a.category AS category_a, b.category AS category_b,
               CASE WHEN a.drink AND b.drink THEN 'DRINK+DRINK' WHEN a.drink OR b.drink THEN 'FOOD+DRINK' ELSE 'FOOD+FOOD' END AS pair_type,
               n AS pair_count, n / a.total AS support, a.orders AS orders_a, b.orders AS orders_b, n / a.orders AS confidence_b_given_a,
               n / b.orders AS confidence_a_given_b, round((n / a.total) / ((a.orders / a.total) * (b.orders / b.total)), 8) AS lift
        FROM (SELECT x.canonical_name AS item_a, y.canonical_name AS item_b, count(*) AS n FROM m_bought x JOIN m_bought y
              ON x.order_guid = y.order_guid AND x.canonical_name < y.canonical_name GROUP BY ALL HAVING count(*) >= 20)
        JOIN m_support a ON item_a = a.canonical_name JOIN m_support b ON item_b = b.canonical_name
        WHERE (n / a.total) / ((a.orders / a.total) * (b.orders / b.total)) >= 0.9
        ORDER BY lift DESC, pair_count DESC, item_a, item_b LIMIT 100""",
    "m_days": """
        SELECT canonical_name, display_name, category_filled, location_id, business_date, sum(quantity) AS qty, avg(true_unit_price) AS price,
               max(is_discounted) AS disc FROM m_gold WHERE canonical_name IS NOT NULL GROUP BY ALL""",
    "m_promo": """
        SELECT canonical_name, min(display_name) AS display_name, min(category_filled) AS category, count(*) AS store_days,
               count(*) FILTER (disc) AS discount_days, avg(qty) FILTER (disc) AS avg_qty_discounted_days, avg(qty) FILTER (NOT disc) AS avg_qty_regular_days,
               count(DISTINCT round_even(price * 100, 0)) AS unique_prices, round(min(price), 6) AS min_price, round(max(price), 6) AS max_price
        FROM m_days GROUP BY canonical_name HAVING count(*) >= 10""",
    "m_flat": """
        SELECT item AS canonical_name, item AS display_name, category, revenue AS net_revenue, order_count AS total_qty, order_count AS orders_with_item,
               avg_price AS avg_unit_price, round(revenue / nullif(order_count, 0), 6) AS avg_net_rev_per_unit,
               round(round(revenue / nullif(order_count, 0), 6) * 0.62::DOUBLE, 6) AS avg_est_margin_per_unit,
               order_count / (SELECT sum(order_count) FROM v_menu) AS popularity FROM v_menu""",
    "c_visits": """
        SELECT c.customer_id, c.location_id, c.order_guid, o.total_amount, o.business_date FROM v_masked c JOIN v_orders o ON c.order_guid = o.order_guid""",
    "c_profiles": """
        SELECT customer_id, location_id, count(DISTINCT order_guid) AS order_count, count(DISTINCT business_date) AS visit_days,
               round(sum(total_amount), 2) AS total_spend, round(sum(total_amount), 2) / count(total_amount) AS avg_order,
               min(business_date) AS first_visit, max(business_date) AS last_visit
        FROM c_visits WHERE customer_id IS NOT NULL GROUP BY customer_id, location_id""",
    "c_people": """
        SELECT customer_id, round(sum(total_amount), 2) AS m, count(DISTINCT business_date) AS f,
               date_diff('day', max(business_date), (SELECT max(business_date) FROM c_visits)) AS r
        FROM c_visits WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    "c_bounds": "SELECT quantile_cont(m, 0.75) AS m75, quantile_cont(m, 0.25) AS m25, quantile_cont(r, 0.25) AS r25, quantile_cont(r, 0.75) AS r75 FROM c_people",
    "c_segments": """
        SELECT *, CASE WHEN f >= 3 AND r <= r25 AND m >= m75 THEN 'Champions' WHEN f >= 2 AND m >= m75 THEN 'Loyal high value'
                       WHEN f = 1 AND r <= r25 THEN 'Rising' WHEN f = 1 AND m >= m75 THEN 'Big-ticket occasional' WHEN f >= 2 AND r > r75 THEN 'Cooling off'
                       WHEN f >= 2 AND m < m25 THEN 'Budget regular' ELSE 'One-time' END AS segment
        FROM c_people, c_bounds""",
    "c_spend_range": "SELECT min(total_spend) AS low, round(quantile_cont(total_spend, 0.95), 6) AS top FROM c_profiles",
}

_VISITS = "strftime(first_visit, '%Y-%m-%d') AS first_visit, strftime(last_visit, '%Y-%m-%d') AS last_visit"

SQL = {
    "item_gold": """
        SELECT order_guid, item_name, canonical_name, location_id, strftime(business_date, '%Y-%m-%d') AS business_date, quantity, order_revenue,
               round(alloc_discount, 6) AS alloc_discount, round(net_line_revenue, 6) AS net_line_revenue, unit_cost, category_filled,
               round(est_cogs, 6) AS est_cogs, round(est_margin, 6) AS est_margin, is_discounted, is_drink FROM m_gold""",
    "item_kpis": "SELECT * EXCLUDE (pop_mid, margin_mid) FROM m_kpis",
    "menu_engineering": "SELECT display_name AS item, category, orders_with_item AS order_count, net_revenue AS revenue, avg_unit_price AS avg_price, quadrant FROM m_kpis",
    "menu_recommendations": "SELECT * FROM m_recs",
    "bundle_action": f"""
        SELECT canonical_name, quadrant, net_revenue, hit AS has_bundle,
               CASE WHEN hit AND quadrant IN ('Puzzle', 'Dog') THEN 'Bundle' ELSE {_ACTION} END AS recommended_action
        FROM (SELECT *, canonical_name IN (SELECT item_a FROM m_pairs UNION ALL SELECT item_b FROM m_pairs) AS hit FROM m_kpis)""",
    "recommendations_from_menu": f"""
        SELECT canonical_name, display_name, category, quadrant, popularity, net_revenue, total_qty, orders_with_item, avg_unit_price, avg_net_rev_per_unit,
               avg_est_margin_per_unit, 0.62::DOUBLE AS est_margin_pct, 0::DOUBLE AS discount_rate, 1::DOUBLE AS cost_coverage, 'Synthetic cost proxy' AS margin_source,
               {_ACTION} AS recommended_action, CASE WHEN orders_with_item >= 100 THEN 'High' WHEN orders_with_item >= 25 THEN 'Medium' ELSE 'Low' END AS confidence
        FROM (SELECT *, {_quadrant('avg_est_margin_per_unit')} AS quadrant
              FROM m_flat, (SELECT median(popularity) AS pop_mid, median(avg_est_margin_per_unit) AS margin_mid FROM m_flat))""",
    "bundle_pairs": "SELECT * FROM m_pairs",
    "promo_opportunities": """
        SELECT *, avg_qty_discounted_days - avg_qty_regular_days AS qty_lift_on_discount_days, round(max_price - min_price, 6) AS price_range,
               CASE WHEN discount_days >= 5 AND avg_qty_discounted_days > avg_qty_regular_days THEN 'Promo candidate'
                    WHEN unique_prices >= 3 THEN 'Review price variation' ELSE 'Monitor' END AS opportunity_type FROM m_promo""",
    "price_margin_candidates": "SELECT * FROM m_recs WHERE recommended_action NOT IN ('Promote', 'Bundle')",
    "action_counts": """
        SELECT action, count(canonical_name) AS items FROM (VALUES ('Promote'), ('Bundle'), ('Re-price'), ('Rework'), ('Remove')) a(action)
        LEFT JOIN m_recs ON recommended_action = action GROUP BY action""",
    "customer_profiles": f"SELECT * REPLACE ({_VISITS}) FROM c_profiles",
    "customer_profiles_rows": f"""
        SELECT customer_id, location_id, count(order_guid) AS order_count, count(DISTINCT business_date) AS visit_days, round(sum(total_amount), 2) AS total_spend,
               round(sum(total_amount), 2) / count(total_amount) AS avg_order, strftime(min(business_date), '%Y-%m-%d') AS first_visit,
               strftime(max(business_date), '%Y-%m-%d') AS last_visit
        FROM c_visits WHERE customer_id IS NOT NULL GROUP BY customer_id, location_id""",
    "rfm_segments": """
        SELECT segment, count(*) AS n_customers, round_even(count(*) / (SELECT count(*) FROM c_people) * 100 * 10, 0) / 10 AS pct,
               round(avg(m), 6) AS avg_total_spend, avg(f) AS avg_visits, avg(r) AS avg_recency_days FROM c_segments GROUP BY segment""",
    "customer_kpis": """
        SELECT count(*) AS customers, count(*) FILTER (visit_days > 1) AS repeat_customers, avg(order_count) AS avg_orders, round(avg(total_spend), 6) AS avg_spend,
               count(*) FILTER (visit_days > 1) / count(*) AS repeat_rate FROM c_profiles HAVING count(*) >= 10""",
    "visit_histogram": """
        SELECT label AS visit_days, count(customer_id) AS customers, CAST(place AS INTEGER) AS sort_order
        FROM (VALUES (0, 1, 1, '1 day'), (1, 2, 2, '2 days'), (2, 3, 4, '3-4 days'), (3, 5, 7, '5-7 days'), (4, 8, 14, '8-14 days'), (5, 15, 1000000, '15+ days')) b(place, low, high, label)
        LEFT JOIN c_profiles ON visit_days BETWEEN low AND high GROUP BY ALL""",
    "repeat_revenue_share": """
        SELECT CASE WHEN visit_days > 1 THEN 'Repeat (>1 visit)' ELSE 'One-Time' END AS segment, round(sum(total_spend), 2) AS revenue FROM c_profiles GROUP BY 1""",
    "spend_histogram": """
        SELECT bin, round(low + bin * ((top - low) / 30), 6) AS bin_start, round(low + (bin + 1) * ((top - low) / 30), 6) AS bin_end, count(*) AS customers
        FROM (SELECT *, CAST(least(floor((least(total_spend, top) - low) / ((top - low) / 30)), 29) AS BIGINT) AS bin FROM c_profiles, c_spend_range) GROUP BY bin, low, top""",
    "customer_order_bins": """
        SELECT CASE WHEN order_count >= 5 THEN '5+ orders' WHEN order_count >= 2 THEN '2-4 orders' ELSE '1 order' END AS customer_segment,
               count(*) AS customers, round(avg(total_spend), 6) AS avg_total_spend, round(avg(avg_order), 6) AS avg_order_value FROM c_profiles GROUP BY 1""",
}
