"""Named questions and privacy operators over the sample tables, with SQL checks."""

from pyspark.sql import functions as F

from saltcellar.operators import customers, privacy
from saltcellar.plans import questions
from saltcellar.plans.samples import QuestionTables

SCOPE = {"start": "19950101", "end": "20011231"}


def _ask(name, **parameters):
    return lambda t: questions.QUESTIONS[name](QuestionTables(t), **parameters)


STOCK_DAY = {"snapshot_date": "20010801"}
ASKED = {
    "daily_revenue": SCOPE, "sales_summary": SCOPE, "average_order_value": SCOPE, "top_items_by_revenue": SCOPE,
    "top_items_by_orders": SCOPE, "specific_item_performance": {"item_name": "small rod", **SCOPE},
    "category_performance": SCOPE, "category_revenue_mix": SCOPE, "order_type_mix": SCOPE,
    "inventory_attention": STOCK_DAY, "review_sentiment": SCOPE, "customer_summary": SCOPE,
    "daily_revenue_min_group": SCOPE, "top_items_with_category": SCOPE, "weekly_revenue": SCOPE, "monthly_revenue": SCOPE,
    "revenue_by_order_type": SCOPE, "average_metrics": SCOPE, "low_inventory": STOCK_DAY, "full_inventory": STOCK_DAY,
    "delivery_tips": SCOPE, "order_types_per_day": SCOPE, "daily_tax": SCOPE, "items_by_row_count": SCOPE,
    "items_by_keyword": {"keyword": "Ring", **SCOPE}, "item_variants": {"keyword": "plate", **SCOPE},
    "items_by_name_or_category": {"keyword": "wine", **SCOPE}, "items_by_group_keyword": {"keyword": "medium", **SCOPE},
    "best_item_on_weekday": {"day_number": 5, **SCOPE}, "revenue_by_weekday": SCOPE,
}

QUERIES = {f"question_{name}": _ask(name, **parameters) for name, parameters in ASKED.items()}
QUERIES |= {
    "suppress_small": lambda t: questions.ask("daily_revenue", QuestionTables(t), **SCOPE),
    "suppressed_rows": lambda t: privacy.suppressed_rows(questions.daily_revenue(QuestionTables(t), **SCOPE)),
    "min_group": lambda t: privacy.min_group(
        t.raw_items, [F.col("order_guid").isNull().alias("unknown"), F.col("location_id"), F.col("item_name")],
        F.sum("quantity").alias("quantity"), threshold=50,
    ).drop("unknown"),
    "guard_output": lambda t: privacy.guard_output(customers.customer_kpis(t.profiles)),
    "guard_tables": lambda t: privacy.permitted(QuestionTables(t), questions.QUESTION_TABLES)["reviews"]
    .groupBy("location_id").agg(F.count(F.lit(1)).alias("reviews")),
}


def _day(column: str, name: str = "date") -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {name}"


_MONEY = "round(sum(total_amount), 2) AS revenue, round(sum(total_amount), 2) / count(total_amount) AS avg_order_value"
_ITEM_SUMS = "CAST(sum(quantity) AS BIGINT) AS order_count, round(sum(total_price), 2) AS revenue, round(sum(total_price), 2) / nullif(sum(quantity), 0) AS avg_price"
_ITEM_ROWS = "count(*) AS order_count, round(sum(total_price), 2) AS revenue"
_ROW_PRICE = "round(sum(total_price), 2) / nullif(sum(quantity), 0) AS avg_price"
_STOCK = "category, current_stock AS stock, reorder_level, status FROM raw_inventory WHERE snapshot_date = '20010801'"
_DAILY = f"SELECT {_day('business_date')}, count(DISTINCT order_guid) AS orders, {_MONEY} FROM v_orders GROUP BY business_date"

SQL = {
    "question_daily_revenue": _DAILY,
    "question_average_order_value": _DAILY,
    "question_sales_summary": f"SELECT count(DISTINCT order_guid) AS orders, {_MONEY}, round(sum(tip_amount), 2) AS tips, round(sum(discount_amount), 2) AS discounts FROM v_orders",
    "question_top_items_by_revenue": f"SELECT item_name AS item, min(category) AS category, {_ITEM_SUMS} FROM v_items GROUP BY item_name ORDER BY revenue DESC, item LIMIT 10",
    "question_top_items_by_orders": f"SELECT item_name AS item, min(category) AS category, {_ITEM_SUMS} FROM v_items GROUP BY item_name ORDER BY order_count DESC, item LIMIT 10",
    "question_specific_item_performance": f"SELECT {_day('business_date')}, item_name AS item, min(category) AS category, {_ITEM_SUMS} FROM v_items WHERE item_name = 'small rod' GROUP BY business_date, item_name",
    "question_category_performance": f"SELECT category, {_ITEM_SUMS} FROM v_items GROUP BY category",
    "question_category_revenue_mix": f"""
        SELECT category, order_count, revenue, round(100 * revenue / sum(revenue) OVER (), 2) AS revenue_share_pct, avg_price,
               rank() OVER (ORDER BY revenue DESC) AS revenue_rank FROM (SELECT category, {_ITEM_SUMS} FROM v_items GROUP BY category)""",
    "question_order_type_mix": f"SELECT order_type, count(DISTINCT order_guid) AS orders, {_MONEY} FROM v_orders GROUP BY order_type",
    "question_inventory_attention": f"SELECT item_name AS item, {_STOCK} AND status <> 'good'",
    "question_review_sentiment": "SELECT sentiment, count(*) AS review_count, avg(rating) AS avg_rating FROM raw_reviews GROUP BY sentiment",
    "question_customer_summary": """
        SELECT CASE WHEN order_count >= 5 THEN '5+ orders' WHEN order_count >= 2 THEN '2-4 orders' ELSE '1 order' END AS customer_segment,
               count(*) AS customers, round(avg(total_spend), 6) AS avg_total_spend, round(avg(avg_order), 6) AS avg_order_value FROM c_profiles GROUP BY 1""",
    "question_daily_revenue_min_group": f"SELECT business_date AS date, count(*) AS orders, {_MONEY} FROM raw_orders GROUP BY business_date HAVING count(*) >= 5",
    "question_top_items_with_category": f"SELECT item_name AS item, category, {_ITEM_ROWS}, {_ROW_PRICE} FROM raw_items GROUP BY item_name, category HAVING count(*) >= 5 ORDER BY revenue DESC, item, category LIMIT 10",
    "question_weekly_revenue": "SELECT strftime(strptime(business_date, '%Y%m%d'), '%Y-W%U') AS week, round(sum(total_amount), 2) AS revenue, count(*) AS orders FROM raw_orders GROUP BY 1 HAVING count(*) >= 5",
    "question_monthly_revenue": "SELECT left(business_date, 6) AS month, round(sum(total_amount), 2) AS revenue, count(*) AS orders FROM raw_orders GROUP BY 1 HAVING count(*) >= 5",
    "question_revenue_by_order_type": f"SELECT order_type, count(*) AS order_count, {_MONEY} FROM raw_orders GROUP BY order_type HAVING count(*) >= 5",
    "question_average_metrics": """
        SELECT 'Average Order Value' AS metric, round(sum(total_amount), 2) / count(total_amount) AS value FROM raw_orders
        UNION ALL SELECT 'Average Tip', round(sum(tip_amount), 2) / count(tip_amount) FROM raw_orders""",
    "question_low_inventory": f"SELECT item_name, {_STOCK} AND status <> 'good'",
    "question_full_inventory": f"SELECT item_name, {_STOCK}",
    "question_delivery_tips": "SELECT round(sum(tip_amount), 2) AS total_tips, count(*) AS delivery_orders, round(sum(tip_amount), 2) / count(tip_amount) AS avg_tip FROM raw_orders WHERE order_type = 'DELIVERY'",
    "question_order_types_per_day": """
        SELECT business_date AS date, count(*) AS total_orders, count(*) FILTER (order_type = 'DELIVERY') AS delivery,
               count(*) FILTER (order_type = 'DINE_IN') AS dine_in, count(*) FILTER (order_type = 'TAKEOUT') AS takeout FROM raw_orders GROUP BY 1 HAVING count(*) >= 5""",
    "question_daily_tax": "SELECT business_date AS date, round(sum(tax_amount), 2) AS value FROM raw_orders GROUP BY 1 HAVING count(*) >= 5",
    "question_items_by_row_count": f"SELECT item_name AS item, category, {_ITEM_ROWS} FROM raw_items GROUP BY item_name, category HAVING count(*) >= 5 ORDER BY order_count DESC, item, category LIMIT 10",
    "question_items_by_keyword": f"SELECT item_name AS item, {_ITEM_ROWS}, {_ROW_PRICE} FROM raw_items WHERE item_name ILIKE '%ring%' GROUP BY 1 HAVING count(*) >= 5",
    "question_item_variants": f"SELECT item_name AS item, {_ITEM_ROWS}, {_ROW_PRICE} FROM raw_items WHERE item_name ILIKE '%plate%' GROUP BY 1 HAVING count(*) >= 5",
    "question_items_by_name_or_category": f"SELECT item_name AS item, category, {_ITEM_ROWS} FROM raw_items WHERE item_name ILIKE '%wine%' OR category ILIKE '%wine%' GROUP BY 1, 2 HAVING count(*) >= 5",
    "question_items_by_group_keyword": f"SELECT item_name AS item, {_ITEM_ROWS} FROM raw_items WHERE item_name ILIKE '%medium%' OR category ILIKE '%medium%' GROUP BY 1 HAVING count(*) >= 5",
    "question_best_item_on_weekday": f"SELECT item_name AS item, {_ITEM_ROWS} FROM raw_items WHERE dayofweek(strptime(business_date, '%Y%m%d')) = 4 GROUP BY 1 HAVING count(*) >= 5 ORDER BY revenue DESC, item LIMIT 1",
    "question_revenue_by_weekday": """
        SELECT dayname(strptime(business_date, '%Y%m%d')) AS day_of_week, CAST(dayofweek(strptime(business_date, '%Y%m%d')) + 1 AS INTEGER) AS day_num,
               round(sum(total_amount), 2) AS revenue, count(*) AS order_count FROM raw_orders GROUP BY 1, 2 HAVING count(*) >= 5""",
    "suppress_small": _DAILY + " HAVING count(DISTINCT order_guid) >= 5",
    "suppressed_rows": f"SELECT count(*) FILTER (orders < 5) AS suppressed FROM ({_DAILY})",
    "min_group": "SELECT location_id, item_name, CAST(sum(quantity) AS BIGINT) AS quantity FROM raw_items GROUP BY ALL HAVING count(*) >= 50",
    "guard_output": """
        SELECT count(*) AS customers, count(*) FILTER (visit_days > 1) AS repeat_customers, avg(order_count) AS avg_orders, round(avg(total_spend), 6) AS avg_spend,
               count(*) FILTER (visit_days > 1) / count(*) AS repeat_rate FROM c_profiles""",
    "guard_tables": "SELECT location_id, count(*) AS reviews FROM raw_reviews GROUP BY 1",
}
