import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.operators import sales, views
from saltcellar.sources import sample

STAMP = dt.datetime(2026, 4, 10)


def orders(spark, *partial):
    base = {
        "order_id": "1", "location_id": "a", "business_date": "20260410", "order_guid": "1", "order_time": None, "order_type": "DINE_IN",
        "total_amount": 10.0, "subtotal": 8.0, "tax_amount": 1.0, "tip_amount": 1.0, "discount_amount": 0.0, "created_at": STAMP,
    }
    made = [{**base, "order_id": p.get("order_guid", "1"), **p} for p in partial]
    names = schemas.TABLES["orders"].fieldNames()
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], schemas.TABLES["orders"])


def test_orders_clean(spark, rows):
    raw = orders(
        spark,
        {"order_guid": "1", "created_at": dt.datetime(2026, 4, 12), "total_amount": 99.0},
        {"order_guid": "1", "created_at": dt.datetime(2026, 4, 11), "order_time": "4/10/26 1:05 PM", "total_amount": 0.0},
        {"order_guid": "2", "order_time": "2026-04-10T23:59:59.123456Z", "order_type": "Delivery take out", "total_amount": 600.0},
        {"order_guid": "3", "order_time": "bad", "order_type": "UNKNOWN", "business_date": "20260231", "total_amount": -5.0},
        {"order_guid": "4", "order_time": "2026-04-10T12:00:00+0000", "order_type": None},
        {"order_guid": "5", "order_type": "pick up", "location_id": "b"},
    )
    one, two, three, four = rows(views.orders_clean(raw, ["a"]), "order_guid")
    assert one["total_amount"] == 0.0 and one["hour_of_day"] == 13 and one["tip_rate"] is None and one["flag_zero_amount"]
    assert two["order_category"] == "Delivery" and two["hour_of_day"] == 23 and two["flag_high_total"] and two["day_of_week"] == "Friday"
    assert three["order_type"] is None and three["order_category"] == "Other" and three["order_time"] is None
    assert three["business_date"] is None and three["flag_negative"]
    assert four["order_time"] is None and four["order_category"] == "Other"


def test_empty_input_gives_empty_views(spark):
    none = orders(spark, {"order_guid": "1"}).limit(0)
    clean = views.orders_clean(none)
    assert clean.count() == 0 and views.daily_sales(clean).count() == 0 and sales.sales_summary(clean).count() == 0
    totals = sales.summary_metrics(sales.sales_summary(clean)).first()
    assert totals["avg_order_value"] == 0.0 and totals["total_revenue"] is None
    assert sales.week_over_week(sales.sales_summary(clean)).first()["revenue_change_pct"] is None


def test_customers_masked(spark, rows):
    schema = schemas.TABLES["customer_orders"]
    data = [
        ("1", "a", "20260410", " Ann@X.org ", "555", "Ann", None), ("2", "a", "20260410", " ", "(555) 01-02", None, None),
        ("3", "a", "20260410", None, None, "Bo", None),
    ]
    one, two, three = rows(views.customers_masked(spark.createDataFrame(data, schema)), "order_guid")
    assert one["customer_id"] == hashlib.sha256(b"ann@x.org").hexdigest() and one["has_phone"]
    assert two["customer_id"] == hashlib.sha256(b"5550102").hexdigest() and not two["has_email"]
    assert three["customer_id"] is None and "first_name" not in three


def test_menu_map_folds_cjk_names(spark, rows):
    items = spark.createDataFrame(
        [("小笼包 Soup Bao (8)",)] * 3 + [("小笼包 Bao",)] * 2 + [("小笼包",), ("Tea",), ("",), (None,), ("面 🔥 Ⓥ",)], "item_name string"
    )
    stock = spark.createDataFrame([("Tea", "Drinks"), ("Tea", "Drinks"), ("Tea", "Bar"), ("小笼包", ""), ("小笼包 Bao", "Food")], "item_name string, category string")
    got = {r["item_name"]: r for r in rows(views.menu_canonical_map(items, stock))}
    assert len(got) == 5
    assert got["小笼包 Bao"]["canonical_name"] == "小笼包" and got["小笼包"]["display_name"] == "Soup Bao"
    assert got["Tea"]["canonical_name"] == "Tea" and got["Tea"]["category"] == "Drinks" and got["小笼包"]["category"] is None
    assert got["面 🔥 Ⓥ"]["display_name"] == "面"


def test_newest_snapshots_win(spark, rows):
    data = [("a", "20260410", "2026-04-10T10:00:00+0000", 1, dt.datetime(2026, 4, 10)), ("a", "20260411", "2026-04-11T10:00:00.5Z", 2, dt.datetime(2026, 4, 11))]
    df = spark.createDataFrame(data, "account_id string, snapshot_date string, snapshot_at string, followers_count int, created_at timestamp")
    got = rows(views.profiles_current(df.withColumn("source_run_id", F.lit("r"))))
    assert len(got) == 1 and got[0]["followers_count"] == 2 and got[0]["snapshot_date"] == dt.date(2026, 4, 11)


def test_location_labels(spark, rows):
    raw = orders(spark, *[{"order_guid": str(n), "location_id": p} for n, p in enumerate(["demo_old_town", "x2", "x1", "y"])])
    known = spark.createDataFrame([("x2", "1 Main Street, Ste 1, Downtown, CA"), ("y", "Plain")], "location_id string, address string")
    got = {r["location_id"]: r["label"] for r in rows(views.location_labels(raw, known))}
    assert got == {"demo_old_town": "Old Town", "x2": "Downtown", "x1": "Location 2", "y": "Plain"}


def test_default_range_and_scope(spark, rows):
    raw = orders(spark, *[{"order_guid": str(n), "business_date": f"202604{n:02d}"} for n in range(1, 31)], {"order_guid": "z", "location_id": "b", "business_date": "20260501"})
    assert views.default_date_range(raw, ["a"], days=5).first().asDict() == {"start_date": "20260426", "end_date": "20260430"}
    assert views.default_date_range(raw, ["b"], days=5).first()["start_date"] == "20260501"
    clean = views.orders_clean(raw)
    days = [r["date"] for r in rows(sales.sales_summary(clean, ["a"], "20260403", dt.date(2026, 4, 5)), "date")]
    assert days == ["20260403", "20260404", "20260405"]


def test_channels_may_overlap(spark, rows):
    clean = views.orders_clean(
        orders(spark, {"order_guid": "1", "order_type": "Take Out Table"}, {"order_guid": "2", "order_type": "api", "tip_amount": None}, {"order_guid": "3", "order_type": "x api"}, {"order_guid": "4", "order_type": "DELIVERY", "tip_amount": 0.0})
    )
    got = rows(sales.sales_by_channel(clean))[0]
    assert (got["takeout_orders"], got["dine_in_orders"], got["api_orders"], got["delivery_orders"], got["other_orders"]) == (1, 1, 1, 1, 1)
    assert got["api_zero_tip_orders"] == 1 and got["api_tips"] == 0.0 and got["delivery_zero_tip_orders"] == 1
    labels = {r["channel"]: r for r in rows(sales.tip_breakdown(sales.sales_by_channel(clean)))}
    assert labels["API"]["zero_tip_pct"] == 100.0 and labels["Dine-in-like"]["tip_pct"] == 12.5


@pytest.mark.parametrize("rate, zero, level", [(12.9, 0.0, "error"), (16.0, 25.0, "error"), (14.0, 0.0, "warning"), (16.0, 18.0, "warning"), (15.0, 17.9, "ok")])
def test_tip_alert(spark, rate, zero, level):
    df = spark.createDataFrame([("Dine-in-like", rate, zero)], "channel string, tip_pct double, zero_tip_pct double")
    assert sales.tip_alert(df).first()["level"] == level


def test_week_over_week_needs_two_weeks(spark):
    days = lambda n: spark.createDataFrame([(f"202604{i:02d}", float(i), 1) for i in range(1, n + 1)], "date string, revenue double, orders int")
    assert sales.week_over_week(days(13)).first()["orders_change_pct"] is None
    got = sales.week_over_week(days(14)).first()
    assert got["orders_change_pct"] == 0.0 and got["revenue_change_pct"] == pytest.approx((77 / 28 - 1) * 100)


def test_weekday_index_uses_mean_of_weekday_means(spark, rows):
    raw = orders(
        spark,
        {"order_guid": "1", "business_date": "20260406", "total_amount": 10.0}, {"order_guid": "2", "business_date": "20260413", "total_amount": 30.0},
        {"order_guid": "3", "business_date": "20260407", "total_amount": 60.0},
    )
    got = rows(sales.weekday_index(views.orders_clean(raw)))
    assert [(r["day"], r["avg_revenue"], r["index"]) for r in got] == [("Mon", 20.0, 0.5), ("Tue", 60.0, 1.5)]


def test_stock_status_and_latest_day(spark, rows):
    stock = spark.createDataFrame(
        [("a", "x", "f", 0.0, 5.0, 1.0, None, "20260401", "good"), ("a", "y", "f", 4.0, 5.0, 1.0, None, "20260401", "low"), ("a", "z", "f", 5.0, 5.0, 1.0, None, "20260402", "good")],
        schemas.TABLES["inventory"],
    )
    assert [r["status"] for r in rows(sales.inventory_status(stock, "20260401"), "item")] == ["critical", "low"]
    assert [r["item"] for r in rows(sales.inventory_status_latest(stock, "20260401"), "item")] == ["x", "y"]
    assert [r["item"] for r in rows(sales.inventory_status_latest(stock, "20260430"), "item")] == ["z"]


def test_menu_performance_fans_out_over_categories(spark, rows):
    items = spark.createDataFrame([("1", "x", "", 2, 4.0, 4.0, "a", "20260401"), ("2", "x", "", 1, 2.0, 2.0, "b", "20260401")], schemas.TABLES["order_items"])
    stock = spark.createDataFrame([("x", "a", "p"), ("x", "a", "q"), ("x", "a", "q"), ("x", "a", "")], "item_name string, location_id string, category string")
    got = rows(sales.menu_performance(items, stock))[0]
    assert got == {"item": "x", "category": "p", "order_count": 3, "revenue": 10.0, "avg_price": 2.0}


def test_optional_review_predicates(spark):
    data = [(str(n), "a", "o", f"2026040{n}", 5, "t", "positive" if n % 2 else "negative", "c") for n in range(1, 6)]
    df = spark.createDataFrame(data, schemas.TABLES["reviews"])
    assert sales.reviews(df).count() == 5 and sales.reviews(df, sentiment="all").count() == 5
    assert sales.reviews(df, ["a"], start="20260402", sentiment="positive").count() == 2 and sales.reviews(df, ["b"]).count() == 0


def test_overtime_bound_is_exclusive(spark, rows):
    df = spark.createDataFrame([("d1", 8.0), ("d2", 5.0), ("d2", 3.01)], "date string, overtime_hours double")
    assert [r["date"] for r in rows(sales.overtime_alerts(df))] == ["d2"]


def test_one_order_with_most_copies(spark, rows):
    copies = orders(spark, {"order_guid": "hot"}).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(20_000))))
    copies = copies.withColumn("created_at", F.col("created_at") + F.make_dt_interval(mins=F.col("n").cast("int"))).withColumn("total_amount", F.col("n").cast("double")).drop("n")
    raw = copies.repartition(8).unionByName(orders(spark, *[{"order_guid": str(n)} for n in range(50)]))
    got = {r["order_guid"]: r["total_amount"] for r in rows(views.orders_clean(raw))}
    assert len(got) == 51 and got["hot"] == 0.0


def test_raw_lines_lie_by_order_for_the_clean_view(spark, rows, tmp_path):
    tables = {
        "region": spark.createDataFrame([(3, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(7, 3)], "n_nationkey int, n_regionkey int"),
        "customer": spark.createDataFrame([(1, "C#1", 7, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": spark.createDataFrame(
            [(5, 1, "O", 9000.0, STAMP, "5-LOW"), (6, 1, "O", 9000.0, STAMP, "5-LOW"), (6, 1, "O", 9000.0, STAMP, "5-LOW"), (None, 1, "O", 1.0, STAMP, "5-LOW")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "part": spark.createDataFrame([(2, "small rod", "SMALL", 1, 5.0)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double"),
        "lineitem": spark.createDataFrame(
            [(5, 2, 1, 3.0, 4000.0, "N", "O"), (6, 2, 1, 2.0, 5000.0, "A", "O"), (8, 2, 1, 1.0, 1.0, "N", "O"), (None, 2, 1, 1.0, 1.0, "N", "O")],
            "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string",
        ),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    raw = sample.order_items(spark, str(tmp_path))
    # The order that is there twice has its line twice; lines without an order have none.
    got = [(r["order_guid"], r["category"], r["quantity"], r["total_price"], r["location_id"], r["business_date"]) for r in rows(raw, "order_guid")]
    assert got == [("5", "Beverages", 3, 4.0, "site_3", "20260410")] + [("6", "", 2, 5.0, "site_3", "20260410")] * 2
    names = spark.createDataFrame([], "item_name string, canonical_name string, display_name string, category string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.order_items_clean(sample.order_items(spark, str(tmp_path)), names)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "cast(l_orderkey" in plan and not any("Exchange hashpartitioning(order_guid" in line and "quantity" in line for line in plan.splitlines())
