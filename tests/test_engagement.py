import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kernels import kernel_weights
from saltcellar.functions.calendar import holiday_name
from saltcellar.operators import engagement, tagging

START = dt.date(2026, 1, 1)


@pytest.mark.parametrize(
    "day, name",
    [
        ("2026-01-01", "New Year's Day"), ("2026-01-19", "Martin Luther King Jr. Day"), ("2026-02-16", "Washington's Birthday"), ("2026-05-25", "Memorial Day"),
        ("2026-07-03", "Independence Day (observed)"), ("2026-07-04", "Independence Day"), ("2026-09-07", "Labor Day"), ("2026-11-26", "Thanksgiving Day"),
        ("2020-06-19", None), ("2021-06-18", "Juneteenth National Independence Day (observed)"), ("2021-12-31", "New Year's Day (observed)"),
        ("2022-12-26", "Christmas Day (observed)"), ("2026-12-24", None), ("2026-10-12", "Columbus Day"),
    ],
)
def test_holidays(spark, day, name):
    assert spark.range(1).select(holiday_name(F.lit(dt.date.fromisoformat(day))).alias("v")).first()["v"] == name


MEDIA = "media_id string, posted_date string, caption string, likes bigint, comments_count string, views bigint, saved bigint, shares bigint, total_interactions bigint"


def test_normalize_and_daily_index(spark, rows):
    data = [
        ("1", "20260101", "Happy HOUR deal", 5, "3", 100, None, 2, None), ("2", "20260101", None, None, "x", None, 1, None, 30),
        ("3", "2026-01-02", "pork bun", 4, "0", 50, 0, 0, None), ("4", "never", "lost", 9, "9", 9, 9, 9, 9),
    ]
    scored = engagement.normalize_media(spark.createDataFrame(data, MEDIA))
    got = {r["media_id"]: r for r in rows(scored)}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"]["total_interactions"], got["2"]["total_interactions"], got["3"]["total_interactions"]) == (10.0, 30.0, 4.0)
    scale = 10 / 75
    assert got["1"]["engagement_score"] == pytest.approx(10 + scale * 100) and got["2"]["engagement_score"] == 30.0
    first, second = rows(engagement.social_daily(scored), "date")
    assert (first["post_count"], first["promo_topic_share"], second["product_topic_share"]) == (2, 0.5, 1.0)
    assert first["engagement_index"] == 100.0 and second["engagement_index"] == 0.0


def test_one_day_has_index_zero(spark):
    scored = engagement.normalize_media(spark.createDataFrame([("1", "20260101", "x", 1, "1", 0, 0, 0, None)], MEDIA))
    assert engagement.social_daily(scored).first()["engagement_index"] == 0.0
    none = engagement.normalize_media(spark.createDataFrame([], MEDIA))
    assert engagement.social_daily(none).count() == 0


def features(spark, days=60, seed=4):
    chance = random.Random(seed)
    data = []
    for place in ("a", "ALL"):
        for n in range(days):
            data.append((place, START + dt.timedelta(days=n), float(chance.randint(50, 90)), chance.randint(5, 9), chance.random() * 100, float(n % 2), chance.random()))
    df = spark.createDataFrame(data, "location_id string, date date, revenue double, transactions bigint, engagement_index double, promo_topic_share double, weighted_promo_signal double")
    return df.withColumns({s: F.lit(0.0) for s in engagement.SIGNALS if s not in df.columns})


def test_lag_measures_against_pandas(spark):
    df = features(spark)
    correlations = engagement.lag_correlations(df)
    got = {(r["location_id"], r["outcome"], r["signal"], r["lag"]): r for r in correlations.collect()}
    assert len(got) == 2 * 2 * 7 * 14
    one = df.filter("location_id = 'a'").orderBy("date").toPandas()
    for signal in ("engagement_index", "promo_topic_share"):
        for lag in (1, 7, 14):
            expected = pd.Series(one[signal]).shift(lag).corr(one["revenue"])
            assert got["a", "revenue", signal, lag]["correlation"] == pytest.approx(expected, abs=1e-7)
            assert got["a", "revenue", signal, lag]["pairs"] == 60 - lag
    assert got["a", "revenue", "event_topic_share", 3]["correlation"] is None
    peaks = {(r["location_id"], r["outcome"], r["signal"]): r["peak_lag"] for r in engagement.peak_lag(correlations).collect()}
    values = [got["a", "revenue", "engagement_index", n]["correlation"] for n in range(1, 15)]
    assert peaks["a", "revenue", "engagement_index"] == int(np.argmax(values)) + 1 and peaks["a", "revenue", "event_topic_share"] == 1
    kernels = engagement.lag_kernel(engagement.peak_lag(correlations))
    weights = kernels.filter("location_id = 'a' AND outcome = 'revenue' AND signal = 'engagement_index'").first()
    assert weights["weights"] == pytest.approx(kernel_weights(weights["peak_lag"])) and sum(weights["weights"]) == pytest.approx(1.0)
    spread = engagement.distributed_lag(df, kernels).filter("location_id = 'a' AND signal = 'engagement_index'").orderBy("date").toPandas()
    expected = sum(w * one["engagement_index"].shift(n).fillna(0.0) for n, w in enumerate(weights["weights"], start=1))
    assert spread["distributed"].to_numpy() == pytest.approx(expected.to_numpy(), abs=1e-5)
    matrix = engagement.lag_matrix(correlations).collect()
    assert [r["signal"] for r in matrix] == list(engagement.SIGNALS) and matrix[0]["lag_14"] == got["ALL", "revenue", "engagement_index", 14]["correlation"]


def test_few_pairs_give_lag_one(spark):
    correlations = engagement.lag_correlations(features(spark, days=9))
    assert {r["peak_lag"] for r in engagement.peak_lag(correlations).collect()} == {1}


def test_features_have_an_all_level(spark, rows):
    daily = spark.createDataFrame(
        [("a", START, 10.0, 2, 0.0), ("b", START, 30.0, 3, 1.0), ("c", START, 99.0, 1, 0.0)],
        "location_id string, business_date date, gross_revenue double, order_count bigint, total_discounts double",
    )
    social = spark.createDataFrame([(START,)], "date date").withColumns({c: F.lit(2.0) for c in engagement.SOCIAL_COLUMNS}).limit(0)
    labels = spark.createDataFrame([("a", "Town")], "location_id string, label string")
    whole, a, b = rows(engagement.engagement_features(daily, social, labels, ["a", "b"]), "location_id")
    assert (whole["location_id"], whole["revenue"], whole["transactions"], whole["avg_ticket"], whole["promo_flag"]) == ("ALL", 40.0, 5, 8.0, True)
    assert whole["location_label"] == "All Selected Locations" and a["location_label"] == "Town" and b["location_label"] == "b"
    assert whole["holiday_name"] == "New Year's Day" and a["post_count"] == 0.0 and not a["promo_flag"]


def test_rolling_mean_and_kpis(spark, rows):
    df = features(spark, days=10).withColumns({c: F.lit(3.0) for c in ("post_count", "total_views", "total_likes")})
    got = rows(engagement.rolling_mean(df, ["revenue"]).filter("location_id = 'a'"), "date")
    plain = [r["revenue"] for r in rows(df.filter("location_id = 'a'"), "date")]
    assert [r["revenue"] for r in got] == pytest.approx(list(pd.Series(plain).rolling(7, min_periods=1).mean()), abs=1e-6)
    kpis = {r["location_id"]: r for r in rows(engagement.engagement_kpis(df))}
    assert kpis["a"]["posts"] == 30 and kpis["a"]["avg_likes"] == 1 and kpis["a"]["avg_ticket"] == pytest.approx(sum(plain) / kpis["a"]["transactions"])


def test_predictive_summary_prefers_the_model(spark, rows):
    correlations = spark.createDataFrame(
        [("ALL", "revenue", "engagement_index", 1, -0.4, 90), ("ALL", "revenue", "engagement_index", 2, 0.3, 90), ("ALL", "revenue", "promo_topic_share", 5, -0.6, 90), ("ALL", "revenue", "promo_topic_share", 4, -0.2, 90)],
        "location_id string, outcome string, signal string, lag int, correlation double, pairs int",
    )
    model = spark.createDataFrame(
        [("engagement_index", 2, -0.01, 0.05), ("promo_topic_share", 9, None, None), ("holiday_flag", None, 0.5, 0.15), ("promo_flag", None, None, None)],
        "predictor string, peak_lag int, beta double, pvalue double",
    )
    got = rows(engagement.predictive_summary(correlations, model, n_days=100))
    assert [(r["signal"], r["lead_time"], r["direction"], r["confidence"]) for r in got] == [
        ("promo_topic_share", 5, "Negative", "Moderate"), ("holiday_flag", None, "Positive", "Directional"), ("engagement_index", 2, "Negative", "High"),
    ]
    assert got[1]["label"] == "Public Holiday"


@pytest.mark.parametrize(
    "question, intent, guard, open_point, lenient",
    [
        ("What drives category SHARE?", "category_revenue_mix", None, None, None), ("What drives category growth?", "category_performance", None, None, None), ("percent by category", "category_revenue_mix", None, None, None),
        ("Soup Dumplings (8pc) stock", "specific_item_performance", None, "filter_type", "filter_type"), ("best dish", "top_items_by_revenue", None, "ranking_basis", "ranking_basis"),
        ("show sales", "sales_summary", None, "time_granularity", None), ("revenue trend", "daily_revenue", None, "time_granularity", "time_granularity"),
        ("total revenue", "sales_summary", None, None, None), ("net earnings please drop", "sales_summary", "destructive", None, None),
        ("select a", "sales_summary", "sql", None, None), ("guest emails", "sales_summary", "pii", None, None), ("every receipt", "sales_summary", "row_level", None, None),
        ("daily revenue", "daily_revenue", None, "metric_type", None),
    ],
)
def test_question_tags(spark, question, intent, guard, open_point, lenient):
    q = F.lit(question)
    got = spark.range(1).select(
        tagging.intent_tag(q).alias("intent"), tagging.guardrail_tag(q).alias("guard"), tagging.ambiguity_tag(q).alias("open"), tagging.ambiguity_tag_lenient(q).alias("lenient")
    ).first()
    assert (got["intent"], got["guard"], got["open"], got["lenient"]) == (intent, guard, open_point, lenient)


def test_topic_model_keeps_rows_of_equal_media_ids(spark, rows):
    captions = ["dumpling noodle pork dumplings", "holiday festival community event"] * 3
    df = spark.createDataFrame([("ab"[n // 3], str(n % 3), c) for n, c in enumerate(captions)], "account_id string, media_id string, caption string")
    assert len(rows(tagging.topic_model(df, neighbours=2, least_size=2))) == 6


def test_summary_without_a_model_reports_the_index(spark, rows):
    correlations = spark.createDataFrame(
        [("ALL", "revenue", "engagement_index", lag, 0.1 * lag, 95) for lag in (1, 2, 3)] + [("ALL", "revenue", "promo_topic_share", 1, 0.9, 95)],
        "location_id string, outcome string, signal string, lag int, correlation double, pairs int",
    )
    model = spark.createDataFrame([], "predictor string, peak_lag int, beta double, pvalue double")
    (only,) = rows(engagement.predictive_summary(correlations, model, n_days=100))
    assert (only["signal"], only["lead_time"], only["direction"], only["confidence"]) == ("engagement_index", 3, "Positive", "Moderate")


def test_topic_model(spark, rows):
    captions = ["dumpling noodle pork dumplings"] * 6 + ["holiday festival community event #sale"] * 6 + ["#only #tags", None, "free coupon xyz"]
    df = spark.createDataFrame([("a", str(n), c) for n, c in enumerate(captions)], "account_id string, media_id string, caption string")
    got = {r["media_id"]: r for r in rows(tagging.topic_model(df))}
    assert len(got) == len(captions) and got["12"]["topic"] is None and got["13"]["promo_topic"] == 0
    assert all(max(r["promo_topic"], r["product_topic"], r["event_topic"]) == 1 for k, r in got.items() if int(k) < 12)
    few = {r["media_id"]: r for r in rows(tagging.topic_model(df.filter("media_id IN ('0', '6', '14')")))}
    assert (few["0"]["product_topic"], few["6"]["event_topic"], few["14"]["promo_topic"]) == (1, 1, 1) and few["0"]["topic"] is None
