"""Social engagement by day, its features next to sales, and lead-lag measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltcellar.functions.calendar import holiday_name
from saltcellar.functions.columns import cents, parse_day, parse_iso_time, ratio
from saltcellar.functions.stats import correlation, quantiles
from saltcellar.operators.tagging import TOPICS, keyword_flags
from saltcellar.session import settle

# Date columns in their order, signals, outcomes, lags, labels, bounds.
DATE_COLUMNS = ("date", "posted_date", "posted_date_utc", "uploaded_date_utc", "timestamp")
SIGNALS = (
    "engagement_index", "promo_topic_share", "product_topic_share", "event_topic_share", "weighted_promo_signal",
    "weighted_product_signal", "weighted_event_signal",
)
OUTCOMES = ("revenue", "transactions")
MAX_LAG, MIN_PAIRS = 14, 10
ALL, ALL_LABEL = "ALL", "All Selected Locations"
SIGNAL_LABELS = {
    "engagement_index": "Instagram Engagement",
    "promo_topic_share": "Promotions",
    "product_topic_share": "Product Features",
    "event_topic_share": "Events and Holidays",
    "weighted_promo_signal": "Promo Content x Engagement",
    "weighted_product_signal": "Product Content x Engagement",
    "weighted_event_signal": "Event Content x Engagement",
    "holiday_flag": "Public Holiday",
    "promo_flag": "In-Store Promotion",
}
SOCIAL_COLUMNS = (
    "post_count", "total_likes", "total_views", "total_post_comments", "comment_count", "promo_topic_share",
    "product_topic_share", "event_topic_share", "weighted_promo_signal", "weighted_product_signal",
    "weighted_event_signal", "total_engagement", "engagement_index",
)


def _number(df: DataFrame, name: str) -> Column:
    return F.col(name).try_cast("double") if name in df.columns else F.lit(None).cast("double")


def _as_date(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "string":
        text = F.col(name)
        return F.coalesce(parse_day(text), F.to_date(parse_iso_time(text)))
    return F.col(name).cast("date")


def normalize_media(media: DataFrame) -> DataFrame:
    """Dated media with filled counters and an engagement score.

    Views weigh as much as the typical interactions per typical view. Only the two counters
    behind that weight are settled, not the captions.
    """
    source = next((c for c in DATE_COLUMNS if c in media.columns), None)
    day = _as_date(media, source) if source else F.lit(None).cast("date")
    fill = lambda name: F.coalesce(_number(media, name), F.lit(0.0))
    parts = fill("likes") + fill("comments_count") + fill("shares") + fill("saved")
    dated = media.withColumns(
        {
            "date": day,
            "id": F.col("id") if "id" in media.columns else F.col("media_id"),
            "caption": F.coalesce("caption", F.lit("")) if "caption" in media.columns else F.lit(""),
            "total_interactions": F.coalesce(_number(media, "total_interactions"), parts),
            "reach": _number(media, "reach"),
            **{name: fill(name) for name in ("likes", "comments_count", "views", "saved", "shares")},
        }
    ).filter(F.col("date").isNotNull())
    counters = settle(dated.select("total_interactions", "views"))
    (interactions,) = quantiles(counters, "total_interactions", [0.5])
    (views,) = quantiles(counters.filter(F.col("views") > 0), "views", [0.5])
    scale = interactions / views if views else 0.0
    return dated.withColumn("engagement_score", F.col("total_interactions") + F.lit(scale) * F.col("views"))


def social_daily(scored: DataFrame) -> DataFrame:
    """Posts, sums, topic shares and a 0-100 engagement index per day.

    `scored` is the normalized media, with topic flags or with captions to take them from.
    """
    if not set(TOPICS) <= set(scored.columns):
        scored = scored.withColumns(keyword_flags(F.col("caption")))
    weighted = lambda topic: F.round(F.sum(F.col("engagement_score") * F.col(topic)), 6)
    sums = scored.groupBy("date").agg(
        F.count("id").alias("post_count"),
        F.sum("likes").alias("total_likes"),
        F.sum("views").alias("total_views"),
        F.sum("comments_count").alias("total_post_comments"),
        F.sum("comments_count").alias("comment_count"),
        *[F.avg(topic).alias(f"{topic}_share") for topic in TOPICS],
        *[weighted(topic).alias(f"weighted_{topic.removesuffix('_topic')}_signal") for topic in TOPICS],
        F.round(F.sum("engagement_score"), 6).alias("total_engagement"),
    )
    # One row per calendar day, so a window over all of them stays small.
    every = Window.partitionBy()

    def scaled(name: str) -> Column:
        low, high = F.min(name).over(every), F.max(name).over(every)
        return F.coalesce(ratio(F.col(name) - low, high - low), F.lit(0.0))

    index = (scaled("total_engagement") + scaled("comment_count") + scaled("post_count")) * 100 / 3
    return sums.withColumn("engagement_index", F.round(index, 6)).orderBy("date")


def engagement_features(
    daily: DataFrame, social: DataFrame, labels: DataFrame, location_ids: Sequence[str] | None = None
) -> DataFrame:
    """Sales per location and day, and over all locations, next to the social day.

    `labels` has location_id and label. Both levels come from one grouping-set aggregate.
    """
    chosen = daily if not location_ids else daily.filter(F.col("location_id").isin(list(location_ids)))
    base = chosen.select(
        "location_id",
        F.col("business_date").alias("date"),
        F.coalesce("gross_revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("order_count", F.lit(0)).alias("transactions"),
        F.coalesce("total_discounts", F.lit(0.0)).alias("discount_amount"),
    )
    level = F.when(F.grouping("location_id") == 1, ALL).otherwise(F.col("location_id"))
    sales = base.groupingSets([["location_id", "date"], ["date"]], "location_id", "date").agg(
        level.alias("place"),
        cents(F.col("revenue")).alias("revenue"),
        F.sum("transactions").alias("transactions"),
        cents(F.col("discount_amount")).alias("discount_amount"),
        F.max(F.col("discount_amount") > 0).alias("promo_flag"),
    )
    name = holiday_name(F.col("date"))
    featured = sales.select(
        F.col("place").alias("location_id"),
        "date",
        "revenue",
        "transactions",
        F.coalesce(ratio(F.col("revenue"), F.col("transactions")), F.lit(0.0)).alias("avg_ticket"),
        "promo_flag",
        "discount_amount",
        name.isNotNull().alias("holiday_flag"),
        name.alias("holiday_name"),
    )
    label = F.when(F.col("location_id") == ALL, ALL_LABEL).otherwise(F.coalesce("label", "location_id"))
    return (
        featured.join(labels, "location_id", "left")
        .withColumn("location_label", label)
        .drop("label")
        .join(social.select("date", *SOCIAL_COLUMNS), "date", "left")
        .withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SOCIAL_COLUMNS})
        .orderBy("location_id", "date")
    )


def holiday_flags(days: DataFrame, day: str = "date") -> DataFrame:
    name = holiday_name(F.col(day))
    return days.withColumns({"holiday_flag": name.isNotNull(), "holiday_name": name})


def rolling_mean(features: DataFrame, columns: Sequence[str], days: int = 7) -> DataFrame:
    """Means over the last rows of each location; fewer rows are used at the start."""
    frame = Window.partitionBy("location_id").orderBy("date").rowsBetween(-(days - 1), 0)
    return features.withColumns({c: F.round(F.avg(c).over(frame), 6) for c in columns})


def engagement_kpis(features: DataFrame) -> DataFrame:
    """Headline figures per location, and over all of them."""
    sums = features.groupBy("location_id").agg(
        cents(F.col("revenue")).alias("revenue"),
        F.sum("transactions").alias("transactions"),
        F.sum("post_count").cast("long").alias("posts"),
        F.sum("total_views").cast("long").alias("views"),
        F.sum("total_likes").alias("_likes"),
    )
    return sums.select(
        "location_id",
        "revenue",
        "transactions",
        "posts",
        "views",
        F.coalesce(ratio(F.col("revenue"), F.col("transactions")), F.lit(0.0)).alias("avg_ticket"),
        F.coalesce(F.floor(ratio(F.col("_likes"), F.col("posts"))), F.lit(0)).alias("avg_likes"),
    )


def _lagged(features: DataFrame, signals: Sequence[str] = SIGNALS, max_lag: int = MAX_LAG) -> DataFrame:
    """One row per location, day and signal with the value and its lags in an array.

    The panel has one row per location and day; a location's days fit one task with ease.
    """
    long = features.select("location_id", "date", *OUTCOMES, *signals).unpivot(
        ["location_id", "date", *OUTCOMES], list(signals), "signal", "value"
    )
    order = Window.partitionBy("location_id", "signal").orderBy("date")
    return long.withColumn("lags", F.array(*[F.lag("value", n).over(order) for n in range(1, max_lag + 1)]))


def lag_correlations(features: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Correlation of each lagged signal with each outcome, per location."""
    pairs = _lagged(features, max_lag=max_lag).select(
        "location_id", "signal", *[F.col(o).cast("double").alias(o) for o in OUTCOMES],
        F.posexplode("lags").alias("place", "shifted"),
    )
    both = pairs.groupBy("location_id", "signal", (F.col("place") + 1).alias("lag")).agg(
        *[F.round(correlation(F.col("shifted"), F.col(o)), 8).alias(o) for o in OUTCOMES],
        *[F.count_if(F.col("shifted").isNotNull() & F.col(o).isNotNull()).alias(f"{o}_pairs") for o in OUTCOMES],
    )
    rows = F.array(
        *[
            F.struct(F.lit(o).alias("outcome"), F.col(o).alias("correlation"), F.col(f"{o}_pairs").alias("pairs"))
            for o in OUTCOMES
        ]
    )
    return both.select("location_id", "signal", "lag", F.explode(rows).alias("row")).select(
        "location_id", "row.outcome", "signal", "lag", "row.correlation", "row.pairs"
    )


def lag_matrix(correlations: DataFrame, location_id: str = ALL, outcome: str = "revenue", max_lag: int = MAX_LAG) -> DataFrame:
    """Signals by lag, in the fixed order of the signals."""
    place = F.array_position(F.array(*[F.lit(s) for s in SIGNALS]), F.col("signal"))
    return (
        correlations.filter((F.col("location_id") == location_id) & (F.col("outcome") == outcome))
        .groupBy("signal")
        .pivot("lag", list(range(1, max_lag + 1)))
        .agg(F.first("correlation"))
        .orderBy(place)
        .select("signal", *[F.col(f"`{n}`").alias(f"lag_{n}") for n in range(1, max_lag + 1)])
    )


def peak_lag(correlations: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """The lag with the best positive correlation, else the largest in size, else 1."""
    r, lag = F.col("correlation"), F.col("lag")
    known = (F.col("pairs") >= min_pairs) & r.isNotNull()
    best = lambda score, keep: F.max_by(F.when(keep, lag), F.when(keep, F.struct(score.alias("r"), (-lag).alias("lag"))))
    return correlations.groupBy("location_id", "outcome", "signal").agg(
        F.coalesce(best(r, known & (r > 0)), best(F.abs(r), known & (r != 0)), F.lit(1)).alias("peak_lag")
    )


def lag_kernel(peaks: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Gaussian weights over the lags around each peak, adding up to one."""
    peak = F.least(F.greatest("peak_lag", F.lit(1)), F.lit(max_lag)).cast("double")
    sigma = F.greatest(F.lit(1.5), peak / 2.5)
    lags = F.sequence(F.lit(1), F.lit(max_lag))
    raw = F.transform(lags, lambda n: F.exp(-0.5 * ((n - peak) / sigma) * ((n - peak) / sigma)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, w: a + w)
    return peaks.withColumn("weights", F.transform(raw, lambda w: w / total))


def distributed_lag(features: DataFrame, kernels: DataFrame, outcome: str = "revenue") -> DataFrame:
    """Each signal's lags weighted by its kernel; values before the start count as zero."""
    chosen = kernels.filter(F.col("outcome") == outcome).select("location_id", "signal", "weights")
    product = F.zip_with("lags", "weights", lambda v, w: F.coalesce(v, F.lit(0.0)) * w)
    value = F.aggregate(product, F.lit(0.0), lambda a, p: a + p)
    return _lagged(features).join(chosen, ["location_id", "signal"]).select(
        "location_id", "date", "signal", F.round(value, 6).alias("distributed")
    )


def _confidence_band(r: Column, p: Column, n: Column) -> Column:
    size = F.coalesce(F.abs(r), F.lit(0.0))
    without_p = F.when((size >= 0.25) & (n >= 90), "Moderate").when(size >= 0.15, "Directional").otherwise("Low")
    with_p = (
        F.when((p < 0.10) & (size >= 0.20) & (n >= 90), "High")
        .when((p < 0.20) & (size >= 0.15) & (n >= 60), "Moderate")
        .when((size >= 0.10) | (p < 0.20), "Directional")
        .otherwise("Low")
    )
    return F.when(p.isNull(), without_p).otherwise(with_p)


def predictive_summary(correlations: DataFrame, model: DataFrame, n_days: int, location_id: str = ALL, outcome: str = "revenue") -> DataFrame:
    """Lead time, direction, correlation, effect and confidence per predictor, strongest first.

    `model` has predictor, peak_lag, beta and pvalue, and may be empty. A predictor whose model lag has no
    correlation takes the best lag of its correlations.
    """
    scope = correlations.filter(
        (F.col("location_id") == location_id) & (F.col("outcome") == outcome) & F.col("correlation").isNotNull()
    )
    r, lag = F.col("correlation"), F.col("lag")
    best = scope.groupBy("signal").agg(
        F.max_by(F.struct(lag.alias("lag"), r.alias("r")), F.when(r > 0, F.struct(r.alias("r"), (-lag).alias("l")))).alias("up"),
        F.max_by(F.struct(lag.alias("lag"), r.alias("r")), F.struct(F.abs(r).alias("r"), (-lag).alias("l"))).alias("any"),
        F.max(F.when(r > 0, 1)).alias("has_up"),
        F.map_from_entries(F.collect_list(F.struct(lag.alias("k"), r.alias("v")))).alias("by_lag"),
    )
    fallback = F.when(F.col("has_up") == 1, F.col("up")).otherwise(F.col("any"))
    at_model = F.try_element_at("by_lag", F.col("peak_lag"))
    labels = F.create_map(*[F.lit(x) for pair in SIGNAL_LABELS.items() for x in pair])
    effects = model.select("predictor", "peak_lag", "beta", "pvalue")
    # The index is reported from its correlations where there is no model of it.
    always = correlations.sparkSession.createDataFrame([("engagement_index",)], "predictor string")
    predictors = effects.select("predictor").union(always).distinct()
    rows = predictors.join(effects, "predictor", "left").join(best, F.col("predictor") == F.col("signal"), "left")
    chosen = rows.withColumns(
        {
            "lead_time": F.when(at_model.isNotNull(), F.col("peak_lag")).otherwise(F.coalesce(fallback["lag"], F.col("peak_lag"))),
            "peak_r": F.coalesce(at_model, fallback["r"]),
        }
    ).filter(F.col("beta").isNotNull() | F.col("peak_r").isNotNull())
    source = F.coalesce("beta", "peak_r")
    return (
        chosen.select(
            F.col("predictor").alias("signal"),
            F.coalesce(F.try_element_at(labels, F.col("predictor")), F.col("predictor")).alias("label"),
            "lead_time",
            F.when(source > 0, "Positive").when(source < 0, "Negative").otherwise("Neutral").alias("direction"),
            "peak_r",
            "beta",
            "pvalue",
            _confidence_band(F.col("peak_r"), F.col("pvalue"), F.lit(n_days)).alias("confidence"),
            F.coalesce(F.abs("beta"), F.abs("peak_r"), F.lit(0.0)).alias("_strength"),
        )
        .orderBy(F.desc("_strength"), "signal")
        .drop("_strength")
    )
