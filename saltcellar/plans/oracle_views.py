"""DuckDB forms of the clean views, used as building blocks of the checks."""

VIEWS: dict[str, str] = {
    "v_orders": """
        SELECT order_id, location_id, CAST(strptime(business_date, '%Y%m%d') AS DATE) AS business_date, order_guid, clock AS order_time,
               CASE WHEN order_type <> 'UNKNOWN' THEN order_type END AS order_type,
               CASE WHEN order_type ILIKE '%delivery%' THEN 'Delivery'
                    WHEN regexp_matches(upper(order_type), 'TAKEOUT|TAKE OUT|PICKUP|PICK UP') THEN 'Takeout'
                    WHEN order_type ILIKE '%dine%' THEN 'Dine-In' ELSE 'Other' END AS order_category,
               total_amount, subtotal, tax_amount, tip_amount, discount_amount, tip_amount / nullif(total_amount, 0) AS tip_rate,
               CAST(hour(clock) AS INTEGER) AS hour_of_day, dayname(strptime(business_date, '%Y%m%d')) AS day_of_week,
               total_amount > 500 AS flag_high_total, total_amount < 0 AS flag_negative, total_amount = 0 AS flag_zero_amount, created_at
        FROM (SELECT *, CASE WHEN order_time LIKE '%Z' THEN coalesce(try_strptime(order_time, '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(order_time, '%Y-%m-%dT%H:%M:%SZ'))
                             ELSE try_strptime(order_time, '%-m/%-d/%y %-I:%M %p') END AS clock
              FROM (SELECT arg_min(r, r.created_at) AS r FROM raw_orders r GROUP BY order_guid) t, LATERAL (SELECT unnest(t.r)))""",
    "v_counts": "SELECT item_name, count(*) AS rows, array_to_string(regexp_extract_all(item_name, '[\\x{4e00}-\\x{9fff}]+'), '') AS key, trim(regexp_replace(item_name, '[\\x{4e00}-\\x{9fff}]+', '', 'g')) AS english FROM raw_items WHERE item_name <> '' GROUP BY item_name",
    "v_shown": """
        SELECT key, trim(regexp_replace(regexp_replace(regexp_replace(english, '\\s*\\(\\d+\\)\\s*', ' ', 'g'),
                    '[\\x{10000}-\\x{10ffff}\\x{2300}-\\x{27ff}\\x{2b00}-\\x{2bff}]', '', 'g'), ' {2,}', ' ', 'g')) AS shown
        FROM v_counts WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY rows DESC, item_name) = 1""",
    "v_stocked": """
        SELECT item_name, category FROM (SELECT item_name, category, count(*) AS n FROM raw_inventory WHERE category <> '' GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY item_name ORDER BY n DESC, category) = 1""",
    "v_map": """
        SELECT c.item_name, CASE WHEN c.key <> '' THEN c.key ELSE c.item_name END AS canonical_name,
               CASE WHEN c.key <> '' THEN coalesce(nullif(s.shown, ''), c.key) ELSE c.item_name END AS display_name, k.category
        FROM v_counts c LEFT JOIN v_shown s ON c.key = s.key LEFT JOIN v_stocked k ON c.item_name = k.item_name""",
    "v_items": """
        SELECT i.order_guid, nullif(i.item_name, '') AS item_name, coalesce(m.canonical_name, nullif(i.item_name, '')) AS canonical_name,
               coalesce(m.display_name, nullif(i.item_name, '')) AS display_name, coalesce(nullif(i.category, ''), m.category) AS category,
               i.quantity, i.prediscount_total, i.total_price, i.total_price / nullif(i.quantity, 0) AS true_unit_price, i.location_id,
               CAST(strptime(i.business_date, '%Y%m%d') AS DATE) AS business_date
        FROM (SELECT * FROM raw_items QUALIFY row_number() OVER (PARTITION BY order_guid, item_name, quantity
                  ORDER BY prediscount_total, total_price, category, location_id, business_date) = 1) i
        LEFT JOIN v_map m ON i.item_name = m.item_name""",
    "v_daily": """
        SELECT location_id, business_date, count(*) AS order_count, round(sum(total_amount), 2) AS gross_revenue,
               round(sum(total_amount - discount_amount), 2) AS net_revenue, round(sum(total_amount), 2) / count(total_amount) AS avg_order_value,
               round(sum(tip_amount), 2) AS total_tips, round(sum(discount_amount), 2) AS total_discounts,
               count(*) FILTER (order_category = 'Delivery') AS delivery_orders, count(*) FILTER (order_category = 'Dine-In') AS dine_in_orders,
               count(*) FILTER (order_category NOT IN ('Delivery', 'Dine-In')) AS takeout_orders
        FROM v_orders WHERE total_amount >= 0 GROUP BY location_id, business_date""",
    "v_masked": """
        SELECT order_guid, location_id, CAST(strptime(business_date, '%Y%m%d') AS DATE) AS business_date,
               CASE WHEN mail <> '' THEN sha256(lower(mail)) WHEN phone <> '' THEN sha256(regexp_replace(phone, '[^0-9]', '', 'g')) END AS customer_id,
               mail <> '' AS has_email, phone <> '' AS has_phone
        FROM (SELECT *, coalesce(trim(customer_email), '') AS mail, coalesce(trim(customer_phone), '') AS phone FROM raw_customers)""",
    "v_media": """
        SELECT account_id, account_label, username, media_id, nullif(caption, '') AS caption, media_type, media_product_type,
               posted_at_raw, moment AS posted_at, posted_date, likes, comments_count, views, reach, saved, shares, total_interactions,
               coalesce(total_interactions, likes + comments_count) AS engagement_total, media_type = 'CAROUSEL' AS is_carousel, source_run_id, created_at
        FROM raw_media WHERE source_run_id = 'run-2'""",
    "v_summary": """
        SELECT strftime(business_date, '%Y%m%d') AS date, count(*) AS orders, round(sum(total_amount), 2) AS revenue,
               round(sum(total_amount), 2) / count(total_amount) AS avg_order_value, round(sum(tip_amount), 2) AS tips,
               round(sum(discount_amount), 2) AS discounts, round(sum(tax_amount), 2) AS tax_amount,
               count(*) FILTER (order_type ILIKE '%delivery%') AS delivery_orders, count(*) FILTER (order_type ILIKE '%dine%') AS dine_in_orders,
               count(*) FILTER (coalesce(order_type, '') NOT ILIKE '%delivery%' AND coalesce(order_type, '') NOT ILIKE '%dine%') AS takeout_orders
        FROM v_orders GROUP BY business_date""",
    "v_channel_marks": """
        SELECT *, regexp_matches(t, 'DINE|TABLE|IN STORE|ORDER-AND-PAY') AS dine, t = 'API' AS api, t LIKE '%DELIVERY%' AS deliv,
               regexp_matches(t, 'TAKEOUT|TAKE OUT|PICKUP|PICK UP') AS take, coalesce(tip_amount, 0) = 0 AS untipped
        FROM (SELECT *, upper(coalesce(order_type, '')) AS t FROM v_orders)""",
    "v_channels": "SELECT strftime(business_date, '%Y%m%d') AS date, count(order_guid) AS orders, round(sum(total_amount), 2) AS revenue, "
    "round(sum(subtotal), 2) AS subtotal, round(sum(total_amount), 2) / count(total_amount) AS avg_order_value, round(sum(tip_amount), 2) AS tips, "
    "round(sum(discount_amount), 2) AS discounts, round(sum(tax_amount), 2) AS tax_amount, "
    "count(*) FILTER (NOT (dine OR api OR deliv OR take)) AS other_orders, "
    + ", ".join(
        f"count(*) FILTER ({m}) AS {n}_orders, coalesce(round(sum(subtotal) FILTER ({m}), 2), 0) AS {n}_subtotal, "
        f"coalesce(round(sum(tip_amount) FILTER ({m}), 2), 0) AS {n}_tips, count(*) FILTER ({m} AND untipped) AS {n}_zero_tip_orders"
        for n, m in (("dine_in", "dine"), ("api", "api"), ("delivery", "deliv"), ("takeout", "take"))
    )
    + " FROM v_channel_marks GROUP BY business_date",
    "v_tips": "SELECT channel, orders, coalesce(tips / nullif(subtotal, 0), 0) * 100 AS tip_pct, coalesce(zt / nullif(orders, 0), 0) * 100 AS zero_tip_pct, tips FROM ("
    + " UNION ALL ".join(
        f"SELECT '{label}' AS channel, CAST(sum({n}_orders) AS BIGINT) AS orders, round(sum({n}_subtotal), 2) AS subtotal, "
        f"round(sum({n}_tips), 2) AS tips, CAST(sum({n}_zero_tip_orders) AS BIGINT) AS zt FROM v_channels"
        for n, label in (("dine_in", "Dine-in-like"), ("api", "API"), ("delivery", "Delivery"), ("takeout", "Takeout"))
    )
    + ") WHERE orders > 0 OR subtotal > 0",
    "v_menu": """
        SELECT i.item_name AS item, min(k.category) AS category, count(*) AS order_count, round(sum(total_price), 2) AS revenue,
               round(sum(total_price), 2) / nullif(sum(quantity), 0) AS avg_price
        FROM raw_items i LEFT JOIN (SELECT DISTINCT item_name, location_id, category FROM raw_inventory WHERE category <> '') k
             ON i.item_name = k.item_name AND i.location_id = k.location_id
        GROUP BY i.item_name""",
    "v_labor": """
        SELECT business_date AS date, employee_name, job_title, clock_in_time, clock_out_time, total_hours, payable_hours, regular_hours,
               overtime_hours, cash_tips, non_cash_tips, total_gratuity, total_tips, wage FROM raw_labor""",
    "v_item_performance": """
        SELECT location_id, canonical_name, display_name, coalesce(nullif(i.category, ''), m.category) AS category,
               strftime(strptime(business_date, '%Y%m%d'), '%Y-%m-%d') AS business_date, CAST(sum(quantity) AS BIGINT) AS total_qty,
               round(sum(total_price), 2) AS total_revenue, count(DISTINCT order_guid) AS order_count,
               round(sum(total_price), 2) / nullif(sum(quantity), 0) AS avg_unit_price
        FROM raw_items i JOIN v_map m ON i.item_name = m.item_name GROUP BY ALL""",
}
