import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.operators import privacy
from saltcellar.plans import questions


def test_count_columns_are_whole_words(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, "x", 1.0)], "orders int, order_count int, n int, pairs_n int, count string, `order total` double")
    assert privacy.count_columns(df) == ["orders", "n", "pairs_n", "order total"]


def test_small_groups_go(spark, rows):
    df = spark.createDataFrame([("a", 4), ("b", 5), ("c", None), ("d", 50)], "k string, orders int")
    seen = Observation()
    assert [r["k"] for r in rows(privacy.suppress_small(df, seen=seen), "k")] == ["b", "d"]
    assert seen.get["suppressed"] == 2 and privacy.suppressed_rows(df).first()["suppressed"] == 2
    plain = spark.createDataFrame([("a", 1)], "k string, order_count int")
    assert privacy.suppress_small(plain).count() == 1


def test_min_group(spark, rows):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 5, "k string")
    assert rows(privacy.min_group(df, [F.col("k")], F.count(F.lit(1)).alias("rows"))) == [{"k": "b", "rows": 5}]


@pytest.mark.parametrize("name", ["order_guid", "ORDER_ID", "customer_id", "customer_email", "last_name"])
def test_raw_columns_are_refused(spark, name):
    with pytest.raises(privacy.PrivacyError, match=name.lower()):
        privacy.guard_output(spark.range(1).withColumnRenamed("id", name))


def test_only_permitted_tables(spark):
    tables = {"orders": spark.range(1), "customer_orders": spark.range(1), "other": spark.range(1)}
    view = privacy.permitted(tables, ["orders", "customer_orders"])
    assert list(view) == ["orders"] and len(view) == 1
    for name in ("customer_orders", "other"):
        with pytest.raises(privacy.PrivacyError, match="not permitted"):
            view[name]


def orders(spark):
    data = []
    for n in range(24):
        day = dt.date(2026, 4, 8) + dt.timedelta(days=n % 4)
        data.append((str(n), "ab"[n % 2], day, str(n), None, "DELIVERY" if n % 3 else "DINE_IN", 10.0 + n, 9.0, 0.5, 1.0, 0.0))
    clean = spark.createDataFrame(data, "order_id string, location_id string, business_date date, order_guid string, order_time timestamp, order_type string, total_amount double, subtotal double, tax_amount double, tip_amount double, discount_amount double")
    raw = clean.withColumn("business_date", F.date_format("business_date", "yyyyMMdd"))
    return {"orders": raw, "orders_clean": clean}


def test_ask_suppresses_and_scopes(spark, rows):
    tables = orders(spark)
    assert len(rows(questions.ask("daily_revenue", tables, start="20260408", end="20260409"))) == 2
    assert rows(questions.ask("daily_revenue", tables, locations=["a"])) != []
    assert rows(questions.ask("daily_revenue", tables, locations=["zz"])) == []
    few = {"orders_clean": tables["orders_clean"].filter("order_guid < '12'")}
    assert len(rows(questions.daily_revenue(few))) > len(rows(questions.ask("daily_revenue", few)))


def test_customer_summary_counts_inside_the_window(spark, rows):
    clean = orders(spark)["orders_clean"]
    masked = clean.select(F.lit("c1").alias("customer_id"), F.lit("a").alias("location_id"), "order_guid").filter("cast(order_guid as int) < 12")
    tables = {"orders_clean": clean, "customer_orders_masked": masked}
    # the customer comes on four days, three orders each; the window ends before the last two
    (inside,) = rows(questions.customer_summary(tables, end="20260409"))
    assert (inside["customers"], inside["avg_total_spend"]) == (1, 6 * 10.0 + 0 + 1 + 4 + 5 + 8 + 9) and inside["customer_segment"] == "5+ orders"
    (one_day,) = rows(questions.customer_summary(tables, start="20260408", end="20260408"))
    assert one_day["customer_segment"] == "2-4 orders"


def test_weekly_and_weekday_numbers(spark, rows):
    data = [(f"{n}", "a", day, f"{n}", None, "X", 1.0, 1.0, 0.0, 0.0, 0.0, None) for n, day in enumerate(["20230101", "20221231", "20240101", "20240107"] * 5)]
    tables = {"orders": spark.createDataFrame(data, schemas.TABLES["orders"])}
    weeks = [r["week"] for r in rows(questions.weekly_revenue(tables))]
    assert weeks == sorted(dt.datetime.strptime(d, "%Y%m%d").strftime("%Y-W%U") for d in ("20230101", "20221231", "20240101", "20240107"))
    assert {(r["day_of_week"], r["day_num"]) for r in rows(questions.revenue_by_weekday(tables))} == {("Sunday", 1), ("Saturday", 7), ("Monday", 2)}


def test_delivery_tips_and_types_per_day(spark, rows):
    tables = orders(spark)
    assert questions.delivery_tips(tables).first().asDict() == {"total_tips": 16.0, "delivery_orders": 16, "avg_tip": 1.0}
    days = rows(questions.order_types_per_day(tables), "date")
    assert len(days) == 4 and sum(r["delivery"] for r in days) == 16 and sum(r["takeout"] for r in days) == 0


def test_every_question_is_listed():
    assert len(questions.QUESTIONS) == 30 and questions.QUESTIONS["average_order_value"] is questions.daily_revenue
