import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kernels import kernel_weights
from saltcellar.functions import stats
from saltcellar.operators import engagement, regression


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def test_quantiles_match_linear_interpolation(spark):
    chance = random.Random(5)
    values = [float(chance.randint(0, 50)) for _ in range(400)] + [7.0] * 200 + [None] * 10
    known = [v for v in values if v is not None]
    wanted = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = stats.quantiles(column(spark, values), "v", wanted)
    assert got == pytest.approx(list(np.quantile(known, wanted)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=30), st.sampled_from([0.1, 0.5, 0.75]))
def test_quantile_of_any_list(spark, values, p):
    assert stats.quantiles(column(spark, values), "v", [p])[0] == pytest.approx(float(np.quantile(values, p)), abs=1e-6)


def test_quantiles_of_nothing(spark):
    assert stats.quantiles(column(spark, [None]), "v", [0.5, 0.9]) == [None, None]


def test_correlation_of_constant_and_partial_columns(spark):
    data = [(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 5.5, 5.0), (None, 9.0, 5.0)]
    df = spark.createDataFrame(data, "x double, y double, c double")
    got = df.select(stats.correlation(F.col("x"), F.col("y")).alias("xy"), stats.correlation(F.col("x"), F.col("c")).alias("xc")).first()
    assert got["xy"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5.5])[0, 1]) and got["xc"] is None


def test_tail_probabilities():
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert stats.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.student_critical(5) == pytest.approx(2.5705818366, abs=1e-6)


def drivers(spark, n=60, constant=False):
    chance = random.Random(11)
    data = []
    for k in range(n):
        orders, value = chance.randint(20, 60), chance.uniform(10, 30)
        rate = 0.1 if constant else chance.uniform(0, 0.2)
        net = 5 * orders + 3 * value - 40 * rate + chance.gauss(0, 2)
        data.append(("ab"[k % 2], dt.date(2026, 1, 1) + dt.timedelta(days=k // 2), float(orders), value, rate, chance.random(), chance.random(), chance.random(), k % 7 >= 5, k % 2, net))
    schema = "location_id string, business_date date, order_count double, avg_order_value double, discount_rate double, dine_in_mix double, delivery_mix double, tip_rate double, is_weekend boolean, store_b int, net_revenue double"
    return spark.createDataFrame(data, schema).withColumn("is_weekend", F.col("is_weekend").cast("int"))


def test_ols_hc3_against_numpy(spark):
    df = drivers(spark)
    x = np.array([[float(r[d]) for d in regression.DRIVERS] for r in df.collect()])
    y = np.array([r["net_revenue"] for r in df.collect()])
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    beta, *_ = np.linalg.lstsq(z, y, rcond=None)
    inverse = np.linalg.inv(z.T @ z)
    leverage = np.einsum("ij,jk,ik->i", z, inverse, z)
    residual = y - z @ beta
    covariance = inverse @ (z.T * (residual / (1 - leverage)) ** 2) @ z @ inverse
    got = {r["feature"]: r for r in regression.ols_hc3(df).collect()}
    for n, name in enumerate(regression.DRIVERS, start=1):
        assert got[name]["beta"] == pytest.approx(beta[n], rel=1e-6, abs=1e-8)
        assert got[name]["std_error"] == pytest.approx(math.sqrt(covariance[n, n]), rel=1e-6)
    r2 = 1 - residual @ residual / ((y - y.mean()) @ (y - y.mean()))
    assert got["order_count"]["r_squared"] == pytest.approx(r2) and got["order_count"]["strongest"] and got["order_count"]["stars"] == "***"


def test_ols_needs_twenty_rows_and_survives_a_constant(spark):
    assert regression.ols_hc3(drivers(spark, 19)).count() == 0
    got = {r["feature"]: r for r in regression.ols_hc3(drivers(spark, 40, constant=True)).collect()}
    assert got["discount_rate"]["beta"] == pytest.approx(0.0, abs=1e-6)


def panel(spark, days=80, places=("a", "b"), flat=False):
    chance = random.Random(2)
    start, data = dt.date(2026, 1, 5), []
    signal = [0.0 if flat else chance.random() * 10 for _ in range(days)]
    for place in places:
        for n in range(days):
            base = 100 + (20 if place == "b" else 0) + (3 * signal[n - 2] if n >= 2 else 0) + chance.gauss(0, 3)
            data.append((place, start + dt.timedelta(days=n), base, n % 9 + 1, n % 11 == 0, n % 5 == 0, signal[n]))
    df = spark.createDataFrame(data, "location_id string, date date, revenue double, transactions bigint, holiday_flag boolean, promo_flag boolean, engagement_index double")
    shares = {s: F.lit(0.0) for s in engagement.SIGNALS if s != "engagement_index"}
    return df.withColumns({**shares, "weighted_promo_signal": F.col("engagement_index") * 0.5 + F.dayofmonth("date")})


def test_dynamic_panel_against_explicit_dummies(spark):
    df = panel(spark)
    got = {r["predictor"]: r for r in regression.dynamic_panel(df).collect()}
    rows = df.orderBy("location_id", "date").toPandas()
    daily = rows.groupby("date").agg(revenue=("revenue", "sum"), engagement_index=("engagement_index", "mean"), weighted_promo_signal=("weighted_promo_signal", "mean"))
    live = ["engagement_index", "weighted_promo_signal"]
    for s in live:
        best = {}
        for lag in range(1, 15):
            pair = daily[[s, "revenue"]].assign(x=daily[s].shift(lag)).dropna()
            if len(pair) >= 10:
                best[lag] = round(float(np.corrcoef(pair["x"], pair["revenue"])[0, 1]), 8)
        peak = max(best, key=best.get)
        assert best[peak] > 0 and got[s]["peak_lag"] == peak
        weights = kernel_weights(peak)
        values = sum(w * daily[s].shift(n).fillna(0.0) for n, w in enumerate(weights, start=1))
        rows[f"dl_{s}"] = rows["date"].map(values.round(6))
    rows["y"] = np.log1p(rows["revenue"])
    rows["l1"], rows["l7"] = (rows.groupby("location_id")["y"].shift(k) for k in (1, 7))
    rows["trend"] = (np.array(rows["date"], dtype="datetime64[D]") - np.datetime64("2026-01-05")).astype(float)
    rows["hol"], rows["pro"] = rows["holiday_flag"].astype(float), rows["promo_flag"].astype(float)
    used = rows.dropna(subset=["l1", "l7"]).copy()
    names = ["l1", "l7", "trend", *[f"dl_{s}" for s in live], "hol", "pro"]
    z = [(used[c] - used[c].mean()) / used[c].std() for c in names]
    dates = used["date"].map(lambda d: d)
    extra = [(dates.map(lambda d: d.weekday()) == k).astype(float) for k in range(1, 7)]
    months = sorted({d.month for d in dates})
    extra += [(dates.map(lambda d: d.month) == m).astype(float) for m in months[1:]]
    extra += [(used["location_id"] == "b").astype(float)]
    x = np.column_stack([np.ones(len(used)), *z, *extra])
    y = used["y"].to_numpy()
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ beta
    freedom = len(y) - np.linalg.matrix_rank(x)
    error = np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * (residual @ residual) / freedom)
    for s, place in (("engagement_index", 4), ("weighted_promo_signal", 5), ("holiday_flag", 6), ("promo_flag", 7)):
        assert got[s]["beta"] == pytest.approx(beta[place], rel=1e-4, abs=1e-7)
        assert got[s]["std_error"] == pytest.approx(error[place], rel=1e-4)
    r2 = 1 - residual @ residual / ((y - y.mean()) @ (y - y.mean()))
    assert got["engagement_index"]["r_squared"] == pytest.approx(r2, rel=1e-6)
    assert got["weighted_event_signal"]["beta"] is None
    curve = regression.response_curves(regression.dynamic_panel(df)).filter("predictor = 'engagement_index'").collect()
    assert len(curve) == 14


def test_dynamic_panel_small_or_flat(spark):
    assert regression.dynamic_panel(panel(spark, days=20)).count() == 0
    got = {r["predictor"]: r for r in regression.dynamic_panel(panel(spark, flat=True), location_id="a").collect()}
    assert got["engagement_index"]["beta"] is None and got["engagement_index"]["peak_lag"] == 1


@pytest.mark.parametrize("r2, days, level", [(0.35, 120, "High"), (0.35, 119, "Moderate"), (0.2, 75, "Moderate"), (0.9, 10, "Directional"), (None, 500, "Directional")])
def test_evidence_level(spark, r2, days, level):
    df = spark.createDataFrame([(r2, days)], "r double, n int")
    assert df.select(regression.evidence_level(F.col("r"), F.col("n")).alias("v")).first()["v"] == level


def test_sample_standardization_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    sample = regression.standardize(df, ["x", "c"], population=False).orderBy("x").first()
    assert sample["x_z"] == pytest.approx(-1 / math.sqrt(2)) and sample["c_z"] == 0.0
    assert regression.standardize(df, ["x", "c"], population=True).orderBy("x").first()["x_z"] == -1.0
