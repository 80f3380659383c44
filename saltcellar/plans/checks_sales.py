"""Clean views and sales reports over the sample tables, with the SQL that checks them."""

from saltcellar.operators import sales, views

DAY = "strftime({0}, '%Y-%m-%d') AS {0}"
TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
BUSINESS_DAY = DAY.format("business_date")

QUERIES = {
    "orders_clean": lambda t: t.orders,
    "order_items_clean": lambda t: t.items,
    "payments_clean": lambda t: t.payments,
    "daily_sales": lambda t: t.daily,
    "item_performance": lambda t: views.item_performance(t.raw_items, t.stored_map),
    "customers_masked": lambda t: t.masked,
    "profiles_current": lambda t: views.profiles_current(t.profile_snapshots).select(
        "account_id", "account_label", "media_count", "followers_count", "snapshot_at", "snapshot_date", "source_run_id"
    ),
    "media_current": lambda t: t.media.drop("children_json", "child_count", "permalink", "media_url", "thumbnail_url"),
    "menu_canonical_map": lambda t: t.name_map,
    "location_labels": lambda t: views.location_labels(t.raw_orders, t.addresses),
    "locations": lambda t: views.locations(t.raw_orders),
    "available_dates": lambda t: views.available_dates(t.raw_orders),
    "default_date_range": lambda t: views.default_date_range(t.raw_orders),
    "sales_summary": lambda t: sales.sales_summary(t.stored_orders),
    "sales_by_channel": lambda t: sales.sales_by_channel(t.stored_orders),
    "menu_performance": lambda t: sales.menu_performance(t.raw_items, t.stored_inventory),
    "menu_performance_qty": lambda t: sales.menu_performance_qty(t.stored_items),
    "inventory_status": lambda t: sales.inventory_status(t.inventory, "20010801"),
    "inventory_status_latest": lambda t: sales.inventory_status_latest(t.inventory, "20010915"),
    "reviews": lambda t: sales.reviews(t.reviews, start="20010101", end="20011231", sentiment="positive"),
    "labor_entries": lambda t: sales.labor_entries(t.labor),
    "daily_drivers": lambda t: sales.daily_drivers(t.daily),
    "daily_drivers_raw": lambda t: sales.daily_drivers_raw(t.stored_orders),
    "weekday_index": lambda t: sales.weekday_index(t.stored_orders),
    "summary_metrics": lambda t: sales.summary_metrics(sales.sales_summary(t.stored_orders)),
    "week_over_week": lambda t: sales.week_over_week(sales.sales_summary(t.stored_orders)),
    "tip_breakdown": lambda t: sales.tip_breakdown(sales.sales_by_channel(t.stored_orders)),
    "tip_alert": lambda t: sales.tip_alert(sales.tip_breakdown(sales.sales_by_channel(t.stored_orders))),
    "inventory_alerts": lambda t: sales.inventory_alerts(sales.inventory_status(t.inventory, "20010801")),
    "overtime_alerts": lambda t: sales.overtime_alerts(sales.labor_entries(t.labor)),
    "top_items_by_revenue": lambda t: sales.top_items(sales.menu_performance(t.raw_items, t.stored_inventory), "revenue"),
    "top_items_by_count": lambda t: sales.top_items(sales.menu_performance(t.raw_items, t.stored_inventory), "order_count"),
    "labor_summary": lambda t: sales.labor_summary(sales.labor_entries(t.labor)),
    "labor_daily": lambda t: sales.labor_daily(sales.labor_entries(t.labor)),
    "labor_top_employees_by_hours": lambda t: sales.labor_top_employees(sales.labor_entries(t.labor)),
    "labor_top_employees_by_tips": lambda t: sales.labor_top_employees(sales.labor_entries(t.labor), "total_tips"),
}

_STATUS = "CASE WHEN current_stock <= 0 THEN 'critical' WHEN current_stock < reorder_level THEN 'low' ELSE 'good' END"
_STOCK = "item_name AS item, category, current_stock AS stock, reorder_level, unit_cost, last_ordered"

SQL = {
    "orders_clean": f"SELECT * REPLACE ({BUSINESS_DAY}, {TIME.format('order_time')}, {TIME.format('created_at')}) FROM v_orders",
    "order_items_clean": f"SELECT * REPLACE ({BUSINESS_DAY}) FROM v_items",
    "payments_clean": f"""
        SELECT order_guid, nullif(payment_method, 'UNKNOWN') AS payment_method, amount,
               strftime(CASE WHEN payment_date LIKE '%Z' THEN coalesce(try_strptime(payment_date, '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(payment_date, '%Y-%m-%dT%H:%M:%SZ'))
                    ELSE try_strptime(payment_date, '%-m/%-d/%y %-I:%M %p') END, '%Y-%m-%d %H:%M:%S') AS payment_date,
               location_id, strftime(strptime(business_date, '%Y%m%d'), '%Y-%m-%d') AS business_date FROM raw_payments""",
    "daily_sales": f"SELECT * REPLACE ({BUSINESS_DAY}) FROM v_daily",
    "item_performance": "SELECT * FROM v_item_performance",
    "customers_masked": f"SELECT * REPLACE ({BUSINESS_DAY}) FROM v_masked",
    "profiles_current": f"""
        SELECT * REPLACE ({TIME.format('snapshot_at')}, {DAY.format('snapshot_date')}) FROM raw_profiles
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY source_run_id DESC) = 1""",
    "media_current": f"SELECT * REPLACE ({TIME.format('posted_at')}, {DAY.format('posted_date')}, {TIME.format('created_at')}) FROM v_media",
    "menu_canonical_map": "SELECT * FROM v_map",
    "location_labels": """
        SELECT location_id, CASE WHEN location_id = 'site_0' THEN 'Africa' WHEN location_id = 'demo_america' THEN 'America'
               WHEN location_id = 'demo_asia' THEN 'Asia' WHEN location_id = 'demo_middle_east' THEN 'Middle East'
               ELSE 'Location ' || row_number() OVER (ORDER BY location_id) END AS label
        FROM (SELECT DISTINCT location_id FROM raw_orders)""",
    "locations": "SELECT DISTINCT location_id FROM raw_orders",
    "available_dates": "SELECT DISTINCT business_date FROM raw_orders",
    "default_date_range": """
        SELECT min(business_date) AS start_date, max(business_date) AS end_date
        FROM (SELECT DISTINCT business_date FROM raw_orders ORDER BY 1 DESC LIMIT 30)""",
    "sales_summary": "SELECT * FROM v_summary",
    "sales_by_channel": "SELECT * FROM v_channels",
    "menu_performance": "SELECT * FROM v_menu",
    "menu_performance_qty": """
        SELECT item_name AS item, min(category) AS category, CAST(sum(quantity) AS BIGINT) AS order_count,
               round(sum(total_price), 2) AS revenue, round(avg(true_unit_price), 6) AS avg_price
        FROM v_items WHERE item_name IS NOT NULL GROUP BY item_name""",
    "inventory_status": f"SELECT {_STOCK}, {_STATUS} AS status FROM raw_inventory WHERE snapshot_date = '20010801'",
    "inventory_status_latest": f"SELECT {_STOCK}, status FROM raw_inventory WHERE snapshot_date = (SELECT max(snapshot_date) FROM raw_inventory)",
    "reviews": "SELECT * FROM raw_reviews WHERE sentiment = 'positive' AND review_date BETWEEN '20010101' AND '20011231'",
    "labor_entries": "SELECT * FROM v_labor",
    "daily_drivers": f"SELECT * REPLACE ({BUSINESS_DAY}) FROM v_daily",
    "daily_drivers_raw": """
        SELECT location_id, strftime(business_date, '%Y-%m-%d') AS business_date, count(order_guid) AS order_count,
               round(sum(total_amount), 2) AS gross_revenue, round(sum(subtotal), 2) AS net_revenue,
               round(sum(total_amount), 2) / count(total_amount) AS avg_order_value, round(sum(tip_amount), 2) AS total_tips,
               round(sum(discount_amount), 2) AS total_discounts, count(*) FILTER (t LIKE '%DELIVERY%') AS delivery_orders,
               count(*) FILTER (t LIKE '%DINE%') AS dine_in_orders,
               count(*) FILTER (t NOT LIKE '%DELIVERY%' AND t NOT LIKE '%DINE%') AS takeout_orders
        FROM (SELECT *, upper(coalesce(order_type, '')) AS t FROM v_orders) GROUP BY location_id, business_date""",
    "weekday_index": """
        WITH days AS (SELECT business_date, round(sum(total_amount), 2) AS revenue FROM v_orders GROUP BY business_date),
             weekdays AS (SELECT isodow(business_date) AS w, strftime(business_date, '%a') AS day, round(sum(revenue), 2) / count(*) AS avg_revenue FROM days GROUP BY ALL)
        SELECT day, round(avg_revenue / (SELECT avg(avg_revenue) FROM weekdays), 8) AS index, avg_revenue FROM weekdays""",
    "summary_metrics": """
        SELECT round(sum(revenue), 2) AS total_revenue, CAST(sum(orders) AS BIGINT) AS total_orders,
               round(sum(revenue), 2) / sum(orders) AS avg_order_value, round(sum(tips), 2) / sum(orders) AS avg_tip FROM v_summary""",
    "week_over_week": """
        WITH ranked AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS n FROM v_summary),
             sums AS (SELECT round(sum(revenue) FILTER (n <= 7), 2) AS r1, round(sum(revenue) FILTER (n BETWEEN 8 AND 14), 2) AS r2,
                             sum(orders) FILTER (n <= 7) AS o1, sum(orders) FILTER (n BETWEEN 8 AND 14) AS o2 FROM ranked)
        SELECT (r1 / r2 - 1) * 100 AS revenue_change_pct, (o1 / o2 - 1) * 100 AS orders_change_pct FROM sums""",
    "tip_breakdown": "SELECT * FROM v_tips",
    "tip_alert": """
        SELECT channel, tip_pct, zero_tip_pct, CASE WHEN tip_pct < 13 OR zero_tip_pct >= 25 THEN 'error'
               WHEN tip_pct < 15 OR zero_tip_pct >= 18 THEN 'warning' ELSE 'ok' END AS level FROM v_tips WHERE channel = 'Dine-in-like'""",
    "inventory_alerts": f"SELECT status, item FROM (SELECT item_name AS item, {_STATUS} AS status FROM raw_inventory WHERE snapshot_date = '20010801') WHERE status <> 'good'",
    "overtime_alerts": """
        SELECT date, round(sum(overtime_hours), 2) AS overtime_hours FROM v_labor GROUP BY date HAVING round(sum(overtime_hours), 2) > 8""",
    "top_items_by_revenue": "SELECT * FROM v_menu ORDER BY revenue DESC, item LIMIT 15",
    "top_items_by_count": "SELECT * FROM v_menu ORDER BY order_count DESC, item LIMIT 15",
    "labor_summary": """
        SELECT round(sum(payable_hours), 2) AS payable_hours, count(DISTINCT employee_name) AS employees,
               round(sum(total_tips), 2) AS total_tips, round(sum(overtime_hours), 2) AS overtime_hours FROM v_labor""",
    "labor_daily": """
        SELECT date, round(sum(payable_hours), 2) AS payable_hours, round(sum(total_tips), 2) AS total_tips,
               round(sum(regular_hours), 2) AS regular_hours, round(sum(overtime_hours), 2) AS overtime_hours FROM v_labor GROUP BY date""",
    "labor_top_employees_by_hours": """
        SELECT employee_name, round(sum(payable_hours), 2) AS payable_hours FROM v_labor GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "labor_top_employees_by_tips": """
        SELECT employee_name, round(sum(total_tips), 2) AS total_tips FROM v_labor GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
}
