import datetime as dt
import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from saltcellar.operators import customers, menu

DAY = dt.date(2026, 4, 10)
ITEMS = (
    "order_guid string, item_name string, canonical_name string, display_name string, category string, quantity bigint, "
    "prediscount_total double, total_price double, true_unit_price double, location_id string, business_date date"
)
ORDERS = "order_guid string, location_id string, business_date date, discount_amount double, total_amount double"
STOCK = "location_id string, item_name string, category string, unit_cost double"


def item(guid, name, quantity=1, price=10.0, category="Food", place="a", day=DAY):
    return (guid, name, name, name, category, quantity, price, price, price / quantity if quantity else None, place, day)


def gold_of(spark, items, orders, stock=()):
    return menu.item_gold(spark.createDataFrame(items, ITEMS), spark.createDataFrame(orders, ORDERS), spark.createDataFrame(list(stock), STOCK))


def test_discount_is_shared_by_line_revenue(spark, rows):
    gold = gold_of(
        spark,
        [item("1", "x", 2, 30.0, ""), item("1", "y", 1, 10.0, None), item("2", "x", 0, 0.0), item("9", "x")],
        [("1", "a", DAY, 4.0, 40.0), ("1", "a", DAY, 4.0, 40.0), ("2", "a", DAY, None, 5.0)],
        [("a", "x", "Wine", 2.0), ("a", "x", "Wine", 4.0)],
    )
    one, two, three = rows(gold, "order_guid", "item_name")
    assert (one["alloc_discount"], one["net_line_revenue"], one["unit_cost"], one["est_margin"]) == (3.0, 27.0, 3.0, 21.0)
    assert one["category_filled"] == "Wine" and one["is_drink"] and one["is_discounted"]
    assert (two["alloc_discount"], two["category_filled"], two["est_margin"]) == (1.0, "UNKNOWN", None)
    assert three["alloc_discount"] == 0.0 and not three["is_discounted"]


def test_quadrants_and_coverage(spark, rows):
    items = [item(str(n), "star", 1, 20.0) for n in range(4)] + [item(str(n), "horse", 1, 5.0) for n in range(4)]
    items += [item("0", "puzzle", 1, 30.0), item("1", "dog", 1, 2.0), item("2", "nothing", 0, 0.0)]
    orders = [(str(n), "a", DAY, 0.0, 1.0) for n in range(5)]
    table = menu.item_kpis(spark.createDataFrame(items, ITEMS), spark.createDataFrame(orders, ORDERS), spark.createDataFrame([("a", "star", "", 4.0)], STOCK))
    got = {r["canonical_name"]: r for r in rows(table)}
    assert {k: v["quadrant"] for k, v in got.items()} == {"star": "Star", "horse": "Plowhorse", "puzzle": "Star", "dog": "Plowhorse", "nothing": "Dog"}
    assert got["star"]["avg_est_margin_per_unit"] == 16.0 and got["star"]["margin_source"] == "Inventory cost" and got["star"]["popularity"] == 1.0
    assert got["nothing"]["margin_axis"] is None and got["nothing"]["est_margin"] == 0.0 and got["nothing"]["cost_coverage"] is None


@pytest.mark.parametrize(
    "quadrant, revenue, bundle, action",
    [
        ("Star", 0.0, True, "Promote"), ("Puzzle", 0.0, False, "Promote"), ("Puzzle", 0.0, True, "Bundle"), ("Plowhorse", 0.0, True, "Re-price"),
        ("Dog", 5000.0, False, "Rework"), ("Dog", 4999.0, False, "Remove"), ("Dog", 9999.0, True, "Bundle"), (None, None, None, "Remove"),
    ],
)
def test_actions(spark, quadrant, revenue, bundle, action):
    df = spark.createDataFrame([(quadrant, revenue, bundle)], "q string, r double, b boolean")
    assert df.select(menu.recommended_action(F.col("q"), F.col("r"), F.col("b")).alias("v")).first()["v"] == action


@pytest.mark.parametrize("orders, coverage, label", [(100, 0.5, "High"), (100, 0.49, "Medium"), (25, None, "Medium"), (24, 1.0, "Low")])
def test_confidence(spark, orders, coverage, label):
    df = spark.createDataFrame([(orders, coverage)], "o int, c double")
    assert df.select(menu.confidence(F.col("o"), F.col("c")).alias("v")).first()["v"] == label


def basket_gold(spark, baskets):
    lines = [(str(n), name, name, "Wine" if name == "w" else "Food", name == "w") for n, basket in enumerate(baskets) for name in basket]
    return spark.createDataFrame(lines, "order_guid string, canonical_name string, display_name string, category_filled string, is_drink boolean")


@pytest.mark.parametrize("run", [1, 3, 64])
def test_pairs_against_brute_force(spark, rows, monkeypatch, run):
    monkeypatch.setattr(menu, "LEADS_PER_RUN", run)
    chance = random.Random(7)
    names = [f"i{n:02d}" for n in range(14)] + ["w"]
    baskets = [chance.choices(names, k=chance.randint(1, 10)) for _ in range(120)] + [["i00", "i01", "w"]] * 60
    got = rows(menu.bundle_pairs(basket_gold(spark, baskets), min_count=12, min_lift=0.0, k=10_000))
    orders, pairs = Counter(), Counter()
    for basket in baskets:
        orders.update(set(basket))
        pairs.update(itertools.combinations(sorted(set(basket)), 2))
    expected = {pair: n for pair, n in pairs.items() if n >= 12}
    assert {(r["item_a"], r["item_b"]): r["pair_count"] for r in got} == expected and len(expected) > 10
    total = len(baskets)
    for r in got:
        a, b = orders[r["item_a"]], orders[r["item_b"]]
        assert r["lift"] == pytest.approx(r["pair_count"] * total / (a * b), rel=1e-7)
        assert r["confidence_b_given_a"] == pytest.approx(r["pair_count"] / a)
        assert r["pair_type"] == ("FOOD+DRINK" if "w" in (r["item_a"], r["item_b"]) else "FOOD+FOOD")


def test_pair_count_bound(spark, rows):
    baskets = [["a", "b"]] * 50 + [["c", "d"]] * 49 + [["a"], ["c"]]
    got = rows(menu.bundle_pairs(basket_gold(spark, baskets), min_lift=0.0))
    assert [(r["item_a"], r["item_b"], r["pair_count"]) for r in got] == [("a", "b", 50)]


def test_promo_needs_ten_store_days(spark, rows):
    days = [DAY + dt.timedelta(days=n) for n in range(10)]
    items, orders = [], []
    for n, day in enumerate(days):
        discount = 2.0 if n < 5 else 0.0
        orders.append((str(n), "a", day, discount, 10.0))
        items.append(item(str(n), "ten", 6 if discount else 3, 30.0, day=day))
        if n < 9:
            items.append(item(str(n), "nine", 1, 10.0, day=day))
    got = rows(menu.promo_opportunities(gold_of(spark, items, orders)))
    assert [r["canonical_name"] for r in got] == ["ten"]
    assert got[0]["opportunity_type"] == "Promo candidate" and got[0]["qty_lift_on_discount_days"] == 3.0
    assert (got[0]["store_days"], got[0]["discount_days"], got[0]["unique_prices"], got[0]["price_range"]) == (10, 5, 2, 5.0)


def test_action_counts_keep_empty_actions(spark, rows):
    df = spark.createDataFrame([("Remove",), ("Remove",), ("Promote",)], "recommended_action string")
    assert [(r["action"], r["items"]) for r in rows(menu.action_counts(df))] == [("Promote", 1), ("Bundle", 0), ("Re-price", 0), ("Rework", 0), ("Remove", 2)]


def visits(spark, plan):
    """plan: customer -> list of (day offset, amount)."""
    masked, orders = [], []
    for who, days in plan.items():
        for n, (offset, amount) in enumerate(days):
            guid = f"{who}-{n}"
            masked.append((guid, "a", who if not who.startswith("none") else None))
            orders.append((guid, "a", DAY + dt.timedelta(days=offset), 0.0, amount))
    return (
        spark.createDataFrame(masked, "order_guid string, location_id string, customer_id string"),
        spark.createDataFrame(orders, ORDERS),
    )


def test_profiles_distinct_and_row_counts(spark, rows):
    masked, orders = visits(spark, {"c": [(0, 10.0), (0, 20.0), (3, 30.0)], "none": [(9, 1.0)]})
    twice = masked.unionByName(masked)
    got = rows(customers.customer_profiles(twice, orders))[0]
    assert (got["order_count"], got["visit_days"], got["total_spend"]) == (3, 2, 120.0)
    assert (got["first_visit"], got["last_visit"]) == (DAY, DAY + dt.timedelta(days=3))
    assert rows(customers.customer_profiles_rows(twice, orders))[0]["order_count"] == 6


def test_rfm_against_pandas(spark, rows):
    chance = random.Random(3)
    plan = {f"c{n}": [(chance.randint(0, 200), float(chance.randint(5, 90))) for _ in range(chance.choice([1, 1, 2, 4, 6]))] for n in range(60)}
    plan["none"] = [(230, 5.0)]
    masked, orders = visits(spark, plan)
    table = pd.DataFrame([(who, offset, amount) for who, days in plan.items() for offset, amount in days], columns=["id", "day", "amount"])
    newest = table["day"].max()
    people = table[table["id"] != "none"].groupby("id").agg(m=("amount", "sum"), f=("day", "nunique"), last=("day", "max"))
    people["r"] = newest - people["last"]
    q = {k: (people[k].quantile(0.25), people[k].quantile(0.75)) for k in ("m", "r")}
    got = {r["customer_id"]: r for r in rows(customers.rfm_customers(masked, orders))}
    assert set(got) == set(people.index)
    for who, p in people.iterrows():
        big, near = p.m >= q["m"][1], p.r <= q["r"][0]
        tests = [
            ("Champions", p.f >= 3 and near and big), ("Loyal high value", p.f >= 2 and big), ("Rising", p.f == 1 and near),
            ("Big-ticket occasional", p.f == 1 and big), ("Cooling off", p.f >= 2 and p.r > q["r"][1]), ("Budget regular", p.f >= 2 and p.m < q["m"][0]), ("One-time", True),
        ]
        assert got[who]["segment"] == next(name for name, hit in tests if hit)
    assert sum(r["n_customers"] for r in rows(customers.rfm_segments(masked, orders))) == 60


def test_distributions(spark, rows):
    counts = [1, 2, 3, 8, 15, 1, 1, 1, 1, 1]
    data = [(f"c{n}", v, v, float(10 * v), 10.0) for n, v in enumerate(counts)]
    df = spark.createDataFrame(data, "customer_id string, order_count bigint, visit_days bigint, total_spend double, avg_order double")
    assert [r["customers"] for r in rows(customers.visit_histogram(df))] == [6, 1, 1, 0, 1, 1]
    assert {r["customer_segment"]: r["customers"] for r in rows(customers.customer_order_bins(df))} == {"1 order": 6, "2-4 orders": 2, "5+ orders": 2}
    assert {r["segment"]: r["revenue"] for r in rows(customers.repeat_revenue_share(df))} == {"Repeat (>1 visit)": 280.0, "One-Time": 60.0}
    assert customers.customer_kpis(df).first()["repeat_rate"] == 0.4 and customers.customer_kpis(df.limit(9)).count() == 0
    bins = rows(customers.spend_histogram(df, bins=4))
    clipped = np.minimum(10.0 * np.array(counts), np.quantile(10.0 * np.array(counts), 0.95))
    expected, _ = np.histogram(clipped, bins=4)
    assert {r["bin"]: r["customers"] for r in bins} == {n: c for n, c in enumerate(expected) if c}
    assert customers.spend_histogram(df.limit(0)).count() == 0


def test_one_order_with_most_lines(spark):
    hot = [item("hot", f"n{n % 40:02d}", n % 7 + 1, float(n % 13 + 1)) for n in range(3000)]
    cold = [item(str(n), f"n{n % 40:02d}", 1, 5.0) for n in range(600)]
    orders = [("hot", "a", DAY, 100.0, 1.0)] + [(str(n), "a", DAY, 1.0, 1.0) for n in range(600)]
    got = gold_of(spark, hot + cold, orders).groupBy("order_guid").agg(F.count(F.lit(1)).alias("n"), F.sum("alloc_discount").alias("d"))
    found = {r["order_guid"]: r for r in got.collect()}
    assert found["hot"]["n"] == 3000 and found["hot"]["d"] == pytest.approx(100.0)
    assert len(found) == 601 and all(r["d"] == pytest.approx(1.0) for k, r in found.items() if k != "hot")
