"""Reports once more for two locations and a window that cuts the sample days, with the scope written out in their SQL."""

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.operators import customers, distinct, menu, sales
from saltcellar.plans import checks_menu, checks_questions, checks_sales, questions
from saltcellar.plans.oracle_views import VIEWS
from saltcellar.plans.samples import QuestionTables
from saltcellar.session import remove_at_exit, scratch_path

PLACES, START, END = ("demo_asia", "demo_america"), "19960310", "19970620"
WINDOW = {"start": START, "end": END}


def _ask(name):
    return lambda t: questions.QUESTIONS[name](QuestionTables(t), locations=list(PLACES), **WINDOW)


WINDOWS = {"spring": (None, "19960301", "19960531"), "two_places": (PLACES, START, END), "all": (None, None, None)}


def _windows(t):
    """Distinct orders and customers of three windows, merged from one stored day table."""
    visits = t.stored_masked.select("location_id", "order_guid", "customer_id").join(t.stored_orders.select("order_guid", "business_date"), "order_guid")
    keys = {"orders": distinct.number_keys(visits, "order_guid"), "customers": distinct.number_keys(visits, "customer_id")}
    path = scratch_path(t.spark, "day-bitmaps")
    distinct.day_bitmaps(visits, keys).write.parquet(path)
    remove_at_exit(t.spark, path)
    days = t.spark.read.parquet(path)
    parts = [distinct.merged_counts(days, *scope).withColumn("period", F.lit(name)) for name, scope in WINDOWS.items()]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("distinct", "counted")


QUERIES = {
    "distinct_by_window": _windows,
    "sales_summary_scoped": lambda t: sales.sales_summary(t.stored_orders, PLACES, START, END),
    "menu_performance_scoped": lambda t: sales.menu_performance(t.raw_items, t.stored_inventory, PLACES, START, END),
    "item_kpis_scoped": lambda t: menu.item_kpis(t.stored_items, t.stored_orders, t.stored_inventory, PLACES, START, END),
    "customer_profiles_scoped": lambda t: customers.customer_profiles(t.stored_masked, t.stored_orders, PLACES, START, END),
    "question_daily_revenue_scoped": _ask("daily_revenue"),
    "question_customer_summary_scoped": _ask("customer_summary"),
    "question_top_items_with_category_scoped": _ask("top_items_with_category"),
}

_HERE = "location_id IN ('demo_asia', 'demo_america')"
_DATES = f"{_HERE} AND business_date BETWEEN DATE '1996-03-10' AND DATE '1997-06-20'"
_TEXTS = f"{_HERE} AND business_date BETWEEN '19960310' AND '19970620'"

# The tables that a scope cuts; whatever is built from them is built once more from the cut ones.
_CUT = {
    "v_orders": f"SELECT * FROM v_orders WHERE {_DATES}",
    "v_items": f"SELECT * FROM v_items WHERE {_DATES}",
    "v_masked": f"SELECT * FROM v_masked WHERE {_HERE}",
    "raw_items": f"SELECT * FROM raw_items WHERE {_TEXTS}",
}
BLOCKS = {f"scoped_{name}": sql for name, sql in _CUT.items()}
_KNOWN = {**VIEWS, **checks_menu.BLOCKS}


def _scoped(sql: str) -> str:
    """SQL with every table that depends on a cut one replaced by its scoped form."""

    def renamed(match: re.Match) -> str:
        name = match[0]
        if name in _CUT:
            return f"scoped_{name}"
        if name not in _KNOWN:
            return name
        inner = _scoped(_KNOWN[name])
        if inner == _KNOWN[name]:
            return name
        BLOCKS.setdefault(f"scoped_{name}", inner)
        return f"scoped_{name}"

    return re.sub(r"[a-z_0-9]+", renamed, sql)


_COUNTED = """
    SELECT '{0}' AS period, 'orders' AS measure, count(DISTINCT order_guid) AS counted FROM c_visits WHERE {1}
    UNION ALL SELECT '{0}', 'customers', count(DISTINCT customer_id) FROM c_visits WHERE {1}"""
SQL = {
    "distinct_by_window": " UNION ALL ".join(_COUNTED.format(name, where) for name, where in (
        ("spring", "business_date BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'"), ("two_places", _DATES), ("all", "true"))),
    "sales_summary_scoped": _scoped(checks_sales.SQL["sales_summary"]),
    "menu_performance_scoped": _scoped(checks_sales.SQL["menu_performance"]),
    "item_kpis_scoped": _scoped(checks_menu.SQL["item_kpis"]),
    "customer_profiles_scoped": _scoped(checks_menu.SQL["customer_profiles"]),
    "question_daily_revenue_scoped": _scoped(checks_questions.SQL["question_daily_revenue"]),
    "question_customer_summary_scoped": _scoped(checks_questions.SQL["question_customer_summary"]),
    "question_top_items_with_category_scoped": _scoped(checks_questions.SQL["question_top_items_with_category"]),
}
