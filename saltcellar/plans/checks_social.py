"""Engagement, tagging, regression and incremental operators over the sample tables, with SQL checks."""

import datetime as dt

from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.operators import engagement, imports, payloads, regression, tagging, views
from saltcellar.session import scratch_path, settle
from saltcellar.sources import files, sinks
from saltcellar.streaming import incremental

TODAY = dt.date(2001, 8, 15)


def _scored(t):
    return engagement.normalize_media(t.media)


def _features(t):
    labels = views.location_labels(t.stored_orders, t.addresses)
    daily = views.daily_sales(t.stored_orders)
    return engagement.engagement_features(daily, engagement.social_daily(_scored(t)), labels)


def _correlations(t):
    return engagement.lag_correlations(settle(_features(t)))


def _drivers(t):
    return regression.driver_features(views.daily_sales(t.stored_orders))


def _standardized(t):
    table = settle(_drivers(t).drop("store_b"))
    columns = ["order_count", "avg_order_value", "tip_rate"]
    whole = regression.standardize(table, columns, population=True)
    both = regression.standardize(
        whole.withColumns({f"{c}_sample": F.col(c) for c in columns}), [f"{c}_sample" for c in columns], population=False
    )
    return both.select(
        "location_id", "business_date", *[F.round(f"{c}{kind}_z", 6).alias(f"{c}{kind}_z") for c in columns for kind in ("", "_sample")]
    )


def _summary(t):
    features = settle(_features(t))
    return engagement.predictive_summary(
        engagement.lag_correlations(features), regression.dynamic_panel(features), n_days=features.select("date").distinct().count()
    )


def _summary_of_correlations(t):
    correlations = settle(_correlations(t))
    peaks = engagement.peak_lag(correlations).filter((F.col("location_id") == "ALL") & (F.col("outcome") == "revenue"))
    none = F.lit(None).cast("double")
    model = peaks.select(F.col("signal").alias("predictor"), "peak_lag", none.alias("beta"), none.alias("pvalue"))
    return engagement.predictive_summary(correlations, model, n_days=100)


def _evidence(t):
    r2 = F.round(F.pow(F.col("correlation"), F.lit(2.0)) * 10, 6)
    return _correlations(t).select(
        "location_id", "outcome", "signal", "lag", regression.evidence_level(r2, F.col("pairs")).alias("level")
    )


def _new_files(t):
    """Runs with files of two headers in between, an append beside them, and a last run with nothing new."""
    root, target, state = (scratch_path(t.spark, n) for n in ("raw", "payments", "state"))
    sheet = t.raw_payments.select("order_guid", "payment_method", F.col("amount").cast("string").alias("amount"), "payment_date")
    wider = sheet.select(F.lit("x").alias("Server"), "payment_date", "amount", "order_guid", F.lit(1).alias("Table"), "payment_method")
    for place, runs, rows in (("store_0", 1, sheet), ("store_1", 2, wider)):
        rows.write.option("header", True).csv(f"{root}/{place}/20010801/PaymentDetails.csv")
        for _ in range(runs):
            incremental.ingest_new_files(t.spark, root, "PaymentDetails", imports.import_payments, target, state, "payments")
        if place == "store_0":
            beside = t.raw_payments.withColumns({"location_id": F.lit("store_2"), "business_date": F.lit("20010801")})
            sinks.append_rows(beside, target, "payments")
    return files.read_table(t.spark, target, "payments")


def _new_orders(t):
    """From order exports to the clean view."""
    root, target, state, log = (scratch_path(t.spark, n) for n in ("raw", "orders", "state", "log"))
    names = {"Order Id": "order_guid", "Opened": "order_time", "Dining Options": "order_type", "Total": "total_amount", "Amount": "subtotal",
             "Tax": "tax_amount", "Tip": "tip_amount", "Discount Amount": "discount_amount"}
    sheet = t.raw_orders.select(*[F.col(c).cast("string").alias(h) for h, c in names.items()], F.lit("z").alias("Server"))
    sheet.write.option("header", True).csv(f"{root}/store_0/20010801/OrderDetails.csv")
    incremental.ingest_new_files(t.spark, root, "OrderDetails", imports.import_orders, target, state, "orders", log)
    clean = views.orders_clean(files.read_table(t.spark, target, "orders"))
    logged = files.read_table(t.spark, log, "import_log").agg(F.sum("rows_imported").alias("logged_rows"))
    return clean.groupBy("location_id").agg(F.count(F.lit(1)).alias("orders"), F.count("order_time").alias("timed")).join(logged)


def _snapshots(t):
    """Two landings, a run after each, and one more run: every landing is taken once."""
    landing, target, state = (scratch_path(t.spark, n) for n in ("landing", "snapshots", "state"))

    def transform(run_id):
        return lambda media: payloads.media_snapshots(
            payloads.insights_pivot(media), F.concat(F.lit("acct_"), F.col("account")), F.col("account"), F.col("account"), F.lit(run_id)
        )

    for run_id in ("run-1", "run-2"):
        t.media_payload.write.mode("append").json(landing)
        incremental.snapshot_append(t.spark, landing, schemas.MEDIA_PAYLOAD, transform(run_id), target, state)
    incremental.snapshot_append(t.spark, landing, schemas.MEDIA_PAYLOAD, transform("run-3"), target, state)
    stored = files.read_table(t.spark, target, "media_snapshots")
    return views.media_current(stored).groupBy("account_id", "source_run_id").agg(
        F.count(F.lit(1)).alias("media"), F.sum("engagement_total").alias("engagement")
    )


def _profile_snapshots(t):
    """Two landings of profiles and a run after each, with log rows; the newest snapshot of each account."""
    landing, target, state, log = (scratch_path(t.spark, n) for n in ("profiles", "profile-snapshots", "state", "log"))

    def transform(run_id):
        return lambda found: payloads.profile_snapshot(found, F.lit(" "), F.lit(run_id), F.lit("UTC"))

    for run_id in ("run-1", "run-2", "run-3"):
        if run_id != "run-3":  # the last run finds nothing new
            t.profile_payload.write.mode("append").json(landing)
        incremental.snapshot_append(t.spark, landing, schemas.PROFILE_PAYLOAD, transform(run_id), target, state, "profile_snapshots", log)
    logged = files.read_table(t.spark, log, "import_log").groupBy(F.col("location_id").alias("account_id")).agg(F.sum("rows_imported").alias("logged_rows"))
    newest = views.profiles_current(files.read_table(t.spark, target, "profile_snapshots"))
    return newest.join(logged, "account_id").select("account_id", "account_label", "media_count", "snapshot_date", "source_run_id", "logged_rows")


def _window(t):
    latest = t.import_log.groupBy("location_id").agg(F.max("import_timestamp").alias("now"))
    start = F.when(F.col("location_id").startswith("site"), F.lit("1999-12-31"))
    return incremental.refresh_window(latest, F.col("now"), start=start, refresh_days=30).drop("now")


def _chunks(t, chunk):
    latest = t.import_log.groupBy("location_id").agg(F.max(F.to_date("import_timestamp")).alias("today"))
    return incremental.backfill_chunks(latest, F.col("today"), years=2, chunk=chunk).drop("today")


def _ranges(t, interval_days=30):
    return incremental.sync_range(t.raw_orders, t.import_log, TODAY, interval_days, source="CSV")


def _tags(t):
    q = F.col("question")
    return t.questions.select(
        "conv_id", "turn", tagging.intent_tag(q).alias("intent"), tagging.intent_tag(q, q.contains("by count")).alias("intent_by_orders")
    )


# Words that the keyword table leaves out.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "at", "on", "an", "as", "or", "be", "de", "la", "le", "les", "el", "en", "new", "tea")

QUERIES = {
    "normalize_media": lambda t: _scored(t).select(
        "account_id", "media_id", "date", "likes", "views", "shares", "total_interactions", F.round("engagement_score", 6).alias("engagement_score")
    ),
    "keyword_topics": lambda t: tagging.keyword_topics(t.media).select("account_id", "media_id", *tagging.TOPICS),
    "topic_model": lambda t: tagging.topic_model(t.media),
    "topic_table": lambda t: tagging.topic_table(t.media),
    "keyword_topic_table": lambda t: tagging.keyword_topic_table(t.media, STOP_WORDS),
    "social_daily": lambda t: engagement.social_daily(_scored(t)),
    "engagement_features": _features,
    "holiday_flag": lambda t: engagement.holiday_flags(t.stored_orders.select(F.col("business_date").alias("date")).distinct()),
    "rolling_mean": lambda t: engagement.rolling_mean(_features(t), ["revenue", "engagement_index"]).select(
        "location_id", "date", "revenue", "engagement_index"
    ),
    "engagement_kpis": lambda t: engagement.engagement_kpis(_features(t)),
    "lag_correlations": _correlations,
    "lag_matrix": lambda t: engagement.lag_matrix(_correlations(t)),
    "peak_lag": lambda t: engagement.peak_lag(_correlations(t)),
    "lag_kernel": lambda t: engagement.lag_kernel(engagement.peak_lag(_correlations(t))).select(
        "location_id", "outcome", "signal", F.posexplode("weights").alias("place", "weight")
    ).withColumn("weight", F.round("weight", 8)),
    "distributed_lag": lambda t: engagement.distributed_lag(
        settle(_features(t)), engagement.lag_kernel(engagement.peak_lag(_correlations(t)))
    ),
    "predictive_summary": _summary,
    "predictive_summary_of_correlations": _summary_of_correlations,
    "intent_tags": _tags,
    "guardrail_tags": lambda t: t.questions.select("conv_id", "turn", tagging.guardrail_tag(F.col("question")).alias("guard")),
    "ambiguity_tags": lambda t: t.questions.select(
        "conv_id", "turn", tagging.ambiguity_tag(F.col("question")).alias("open_point"),
        tagging.ambiguity_tag_lenient(F.col("question")).alias("open_point_lenient"),
    ),
    "driver_features": _drivers,
    "standardize": _standardized,
    "ols_hc3": lambda t: regression.ols_hc3(_drivers(t)),
    "dynamic_panel": lambda t: regression.dynamic_panel(_features(t)),
    "response_curves": lambda t: regression.response_curves(regression.dynamic_panel(_features(t))),
    "evidence_level": _evidence,
    "new_files": _new_files,
    "new_orders_clean": _new_orders,
    "snapshot_append": _snapshots,
    "profile_snapshot_append": _profile_snapshots,
    "sync_range": _ranges,
    "latest_import_date": lambda t: incremental.latest_import_date(t.import_log, source="API"),
    "imported_dates": lambda t: incremental.imported_dates(t.import_log, source="CSV"),
    "pending_dates": lambda t: incremental.pending_dates(
        t.raw_orders.groupBy("location_id").agg(F.min("business_date").alias("start_date"), F.max("business_date").alias("end_date")),
        t.import_log, source="API",
    ),
    "unlogged_imports": lambda t: incremental.unlogged_imports(t.raw_orders, t.import_log, "CSV").drop("import_id", "import_timestamp"),
    "refresh_window": _window,
    "backfill_chunks_by_year": lambda t: _chunks(t, "year"),
    "backfill_chunks_by_quarter": lambda t: _chunks(t, "quarter"),
    "backfill_chunks_by_month": lambda t: _chunks(t, "month"),
}



def _any(text: str, words) -> str:
    return "(" + " OR ".join("contains({0}, '{1}')".format(text, w.replace("'", "''")) for w in words) + ")"


_FLAGS = ", ".join(f"CAST({_any('low', words)} AS INTEGER) AS {topic}" for topic, words in tagging.TOPIC_KEYWORDS.items())
_SOCIAL = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in engagement.SOCIAL_COLUMNS)
_R = "covar_pop(y, x) / nullif(stddev_pop(x) * stddev_pop(y), 0)"


def _intent(top: str) -> str:
    w = tagging.INTENT_WORDS
    cases = [
        (f"{_any('q', tagging.CATEGORY_WORDS)} AND {_any('q', tagging.MIX_WORDS)}", "'category_revenue_mix'"),
        (_any("q", [i.lower() for i in tagging.KNOWN_ITEMS]), "'specific_item_performance'"),
    ] + [(_any("q", words), top if name == "top_items" else f"'{name}'") for name, words in w.items()]
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " ELSE 'sales_summary' END"


_OPEN = "CASE " + " ".join(
    f"WHEN {_any('q', raised)} AND NOT {_any('q', answered)} THEN '{name}'" for name, (raised, answered) in tagging.AMBIGUITY_WORDS.items()
) + " END"

BLOCKS = {
    "e_filled": """
        SELECT account_id, media_id, posted_date AS date, lower(coalesce(caption, '')) AS low, CAST(likes AS DOUBLE) AS likes, CAST(comments_count AS DOUBLE) AS comments,
               CAST(coalesce(views, 0) AS DOUBLE) AS views, CAST(coalesce(shares, 0) AS DOUBLE) AS shares,
               CAST(coalesce(total_interactions, likes + comments_count + coalesce(shares, 0) + saved) AS DOUBLE) AS total_interactions
        FROM v_media WHERE posted_date IS NOT NULL""",
    "e_scored": """
        SELECT *, total_interactions + (SELECT median(total_interactions) FROM e_filled) / (SELECT median(views) FROM e_filled WHERE views > 0) * views AS score FROM e_filled""",
    "e_flagged": f"SELECT *, {_FLAGS} FROM e_scored",
    "e_days": """
        SELECT date, count(media_id) AS post_count, sum(likes) AS total_likes, sum(views) AS total_views, sum(comments) AS total_post_comments, sum(comments) AS comment_count,
               avg(promo_topic) AS promo_topic_share, avg(product_topic) AS product_topic_share, avg(event_topic) AS event_topic_share,
               round(sum(score * promo_topic), 6) AS weighted_promo_signal, round(sum(score * product_topic), 6) AS weighted_product_signal,
               round(sum(score * event_topic), 6) AS weighted_event_signal, round(sum(score), 6) AS total_engagement
        FROM e_flagged GROUP BY date""",
    "e_social": """
        SELECT *, round(((total_engagement - min(total_engagement) OVER ()) / (max(total_engagement) OVER () - min(total_engagement) OVER ())
               + (comment_count - min(comment_count) OVER ()) / (max(comment_count) OVER () - min(comment_count) OVER ())
               + (post_count - min(post_count) OVER ()) / (max(post_count) OVER () - min(post_count) OVER ())) * 100 / 3, 6) AS engagement_index
        FROM e_days""",
    "e_fixed": """
        SELECT make_date(y, m, d) AS day, name FROM range(1990, 2030) years(y),
               (VALUES (1, 1, 'New Year''s Day'), (6, 19, 'Juneteenth National Independence Day'), (7, 4, 'Independence Day'), (11, 11, 'Veterans Day'), (12, 25, 'Christmas Day')) f(m, d, name)
        WHERE m <> 6 OR y >= 2021""",
    "e_holidays": """
        SELECT day, name FROM e_fixed
        UNION ALL SELECT CASE dayofweek(day) WHEN 6 THEN day - 1 ELSE day + 1 END, name || ' (observed)' FROM e_fixed WHERE dayofweek(day) IN (0, 6)
        UNION ALL
        SELECT CAST(CASE WHEN m = 5 THEN make_date(y, 5, 31) - CAST((dayofweek(make_date(y, 5, 31)) + 6) % 7 AS INTEGER)
                    ELSE make_date(y, m, 1) + CAST((w - dayofweek(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1) AS INTEGER) END AS DATE), name
        FROM range(1990, 2030) years(y), (VALUES (1, 1, 3, 'Martin Luther King Jr. Day'), (2, 1, 3, 'Washington''s Birthday'), (5, 1, 0, 'Memorial Day'), (9, 1, 1, 'Labor Day'),
             (10, 1, 2, 'Columbus Day'), (11, 4, 4, 'Thanksgiving Day')) f(m, w, n, name)""",
    "e_names": "SELECT day, coalesce(min(name) FILTER (name NOT LIKE '%observed%'), min(name)) AS name FROM e_holidays GROUP BY day",
    "e_labels": "SELECT * FROM (VALUES ('site_0', 'Africa'), ('demo_america', 'America'), ('demo_asia', 'Asia'), ('demo_middle_east', 'Middle East'), ('site_3', 'Location 5'), ('ALL', 'All Selected Locations')) l(location_id, location_label)",
    "e_sales": """
        SELECT location_id, business_date AS date, gross_revenue AS revenue, order_count AS transactions, total_discounts AS discount_amount FROM v_daily
        UNION ALL SELECT 'ALL', business_date, round(sum(gross_revenue), 2), CAST(sum(order_count) AS BIGINT), round(sum(total_discounts), 2) FROM v_daily GROUP BY business_date""",
    "e_features": f"""
        SELECT s.location_id, s.date, revenue, transactions, revenue / transactions AS avg_ticket, discount_amount > 0 AS promo_flag, discount_amount,
               h.name IS NOT NULL AS holiday_flag, h.name AS holiday_name, location_label, {_SOCIAL}
        FROM e_sales s LEFT JOIN e_names h ON s.date = h.day LEFT JOIN e_labels l ON s.location_id = l.location_id LEFT JOIN e_social m ON s.date = m.date""",
    "e_long": """
        SELECT location_id, date, signal, value, CAST(revenue AS DOUBLE) AS revenue, CAST(transactions AS DOUBLE) AS transactions,
               row_number() OVER (PARTITION BY location_id, signal ORDER BY date) AS n
        FROM (SELECT location_id, date, revenue, transactions, engagement_index, promo_topic_share, product_topic_share, event_topic_share, weighted_promo_signal,
                     weighted_product_signal, weighted_event_signal FROM e_features)
        UNPIVOT (value FOR signal IN (engagement_index, promo_topic_share, product_topic_share, event_topic_share, weighted_promo_signal, weighted_product_signal, weighted_event_signal))""",
    "e_pairs": """
        SELECT b.location_id, b.signal, CAST(g.lag AS INTEGER) AS lag, b.n AS n, a.value AS x, b.revenue, b.transactions
        FROM e_long b, range(1, 15) g(lag), e_long a WHERE a.location_id = b.location_id AND a.signal = b.signal AND a.n = b.n - g.lag""",
    "e_places": "SELECT DISTINCT location_id, signal, CAST(g.lag AS INTEGER) AS lag FROM e_long, range(1, 15) g(lag)",
    "e_corr": f"""
        SELECT p.location_id, outcome, p.signal, p.lag, c.correlation, coalesce(c.pairs, 0) AS pairs
        FROM e_places p, (VALUES ('revenue'), ('transactions')) o(outcome) LEFT JOIN (
            SELECT location_id, 'revenue' AS oc, signal, lag, round({_R.replace('y', 'revenue')}, 8) AS correlation, count(*) AS pairs FROM e_pairs GROUP BY ALL
            UNION ALL
            SELECT location_id, 'transactions', signal, lag, round({_R.replace('y', 'transactions')}, 8), count(*) FROM e_pairs GROUP BY ALL) c
        ON p.location_id = c.location_id AND p.signal = c.signal AND p.lag = c.lag AND outcome = oc""",
    "e_peaks": """
        SELECT location_id, outcome, signal, coalesce(
               (max({'r': correlation, 'k': -lag, 'lag': lag}) FILTER (pairs >= 10 AND correlation > 0))['lag'],
               (max({'r': abs(correlation), 'k': -lag, 'lag': lag}) FILTER (pairs >= 10 AND correlation <> 0))['lag'], 1) AS peak_lag
        FROM e_corr GROUP BY location_id, outcome, signal""",
    "e_raw_weights": """
        SELECT location_id, outcome, signal, CAST(lag - 1 AS INTEGER) AS place,
               exp(-0.5 * pow((lag - peak_lag) / greatest(1.5::DOUBLE, peak_lag / 2.5::DOUBLE), 2)) AS w FROM e_peaks, range(1, 15) g(lag)""",
    "e_weights": "SELECT *, w / sum(w) OVER (PARTITION BY location_id, outcome, signal) AS weight FROM e_raw_weights",
    "r_drivers": """
        SELECT location_id, business_date, CAST(order_count AS DOUBLE) AS order_count, avg_order_value, total_discounts / nullif(gross_revenue, 0) AS discount_rate,
               dine_in_orders / nullif(order_count, 0) AS dine_in_mix, delivery_orders / nullif(order_count, 0) AS delivery_mix, total_tips / nullif(gross_revenue, 0) AS tip_rate,
               CAST(isodow(business_date) >= 6 AS INTEGER) AS is_weekend,
               CAST(location_id = (SELECT min(location_id) FROM v_daily WHERE location_id > (SELECT min(location_id) FROM v_daily)) AS INTEGER) AS store_b, net_revenue
        FROM v_daily WHERE gross_revenue <> 0""",
    "t_latest": "SELECT location_id, max(import_timestamp) AS now FROM raw_import_log GROUP BY 1",
}


def _chunk_sql(months: int) -> str:
    return f"""
        SELECT location_id, strftime(s, '%Y%m%d') AS start_date, strftime(least(CAST(s + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE), CAST(now AS DATE)), '%Y%m%d') AS end_date
        FROM t_latest, LATERAL (SELECT unnest(generate_series(make_date(year(now) - 2, 1, 1), make_date(year(now) - 1, 12, 31), INTERVAL {months} MONTH)) AS s)
        WHERE s <= now"""


_DATE = "strftime(date, '%Y-%m-%d') AS date"

SQL = {
    "normalize_media": f"SELECT account_id, media_id, {_DATE}, likes, views, shares, total_interactions, round(score, 6) AS engagement_score FROM e_scored",
    "keyword_topic_table": f"""
        WITH k_texts AS (SELECT trim(regexp_replace(coalesce(caption, ''), '#\\w+', '', 'g')) AS text FROM v_media),
        k_flagged AS (SELECT text, {_FLAGS} FROM (SELECT text, lower(text) AS low FROM k_texts)),
        k_rows AS (SELECT text, CASE WHEN promo_topic = 1 THEN 'promo_topic' WHEN product_topic = 1 THEN 'product_topic' WHEN event_topic = 1 THEN 'event_topic' END AS topic FROM k_flagged),
        k_words AS (
            SELECT text, any_value(topic) AS topic, count(*) AS copies,
                   list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})) AS w
            FROM k_rows WHERE text <> '' GROUP BY text),
        k_terms AS (
            SELECT text, topic, copies, term, count(*) AS tf FROM (
                SELECT text, topic, copies, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                       list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM k_words) GROUP BY ALL),
        k_kept AS (SELECT * FROM k_terms WHERE term IN (SELECT term FROM k_terms GROUP BY term HAVING sum(copies) >= 2) AND topic IS NOT NULL),
        k_each AS (SELECT topic, term, sum(tf * copies) AS tf FROM k_kept GROUP BY ALL),
        k_weights AS (
            SELECT topic, term, e.tf / a.n * ln(1 + (SELECT avg(n) FROM (SELECT sum(tf) AS n FROM k_each GROUP BY topic)) / t.n) AS weight
            FROM k_each e JOIN (SELECT topic, sum(tf) AS n FROM k_each GROUP BY topic) a USING (topic) JOIN (SELECT term, sum(tf) AS n FROM k_each GROUP BY term) t USING (term)),
        k_top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS place FROM k_weights)
        SELECT r.topic, r.topic AS category, r.size, coalesce(string_agg(term, ', ' ORDER BY place), '') AS words
        FROM (SELECT topic, count(*) AS size FROM k_rows GROUP BY topic) r LEFT JOIN k_top p ON p.topic = r.topic AND place <= 5 GROUP BY ALL""",
    "keyword_topics": f"SELECT account_id, media_id, {_FLAGS} FROM (SELECT *, lower(coalesce(caption, '')) AS low FROM v_media)",
    "social_daily": f"SELECT * REPLACE ({_DATE}) FROM e_social",
    "engagement_features": f"SELECT * REPLACE ({_DATE}) FROM e_features",
    "holiday_flag": f"SELECT strftime(d.date, '%Y-%m-%d') AS date, name IS NOT NULL AS holiday_flag, name AS holiday_name FROM (SELECT DISTINCT business_date AS date FROM v_orders) d LEFT JOIN e_names ON d.date = day",
    "rolling_mean": f"""
        SELECT location_id, {_DATE}, round(avg(revenue) OVER w, 6) AS revenue, round(avg(engagement_index) OVER w, 6) AS engagement_index FROM e_features
        WINDOW w AS (PARTITION BY location_id ORDER BY e_features.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "engagement_kpis": """
        SELECT location_id, round(sum(revenue), 2) AS revenue, CAST(sum(transactions) AS BIGINT) AS transactions, CAST(sum(post_count) AS BIGINT) AS posts, CAST(sum(total_views) AS BIGINT) AS views,
               round(sum(revenue), 2) / sum(transactions) AS avg_ticket, CAST(floor(sum(total_likes) / sum(post_count)) AS BIGINT) AS avg_likes FROM e_features GROUP BY location_id""",
    "lag_correlations": "SELECT * FROM e_corr",
    "lag_matrix": "SELECT signal, " + ", ".join(f"max(correlation) FILTER (lag = {n}) AS lag_{n}" for n in range(1, 15))
    + " FROM e_corr WHERE location_id = 'ALL' AND outcome = 'revenue' GROUP BY signal",
    "peak_lag": "SELECT * FROM e_peaks",
    "lag_kernel": "SELECT location_id, outcome, signal, place, round(weight, 8) AS weight FROM e_weights",
    "distributed_lag": """
        SELECT v.location_id, strftime(v.date, '%Y-%m-%d') AS date, v.signal, round("""
    + " + ".join(f"coalesce(lag(v.value, {n}) OVER w, 0) * k.weights[{n}]" for n in range(1, 15))
    + """, 6) AS distributed
        FROM e_long v JOIN (
            SELECT location_id, signal, list(weight ORDER BY place) AS weights FROM e_weights WHERE outcome = 'revenue' GROUP BY ALL) k
        ON v.location_id = k.location_id AND v.signal = k.signal WINDOW w AS (PARTITION BY v.location_id, v.signal ORDER BY v.date)""",
    "predictive_summary_of_correlations": """
        SELECT p.signal, label, p.peak_lag AS lead_time, CASE WHEN c.correlation > 0 THEN 'Positive' WHEN c.correlation < 0 THEN 'Negative' ELSE 'Neutral' END AS direction,
               c.correlation AS peak_r, CAST(NULL AS DOUBLE) AS beta, CAST(NULL AS DOUBLE) AS pvalue,
               CASE WHEN abs(c.correlation) >= 0.25 THEN 'Moderate' WHEN abs(c.correlation) >= 0.15 THEN 'Directional' ELSE 'Low' END AS confidence
        FROM e_peaks p JOIN e_corr c ON p.location_id = c.location_id AND p.outcome = c.outcome AND p.signal = c.signal AND p.peak_lag = c.lag
        JOIN (VALUES ('engagement_index', 'Instagram Engagement'), ('promo_topic_share', 'Promotions'), ('product_topic_share', 'Product Features'), ('event_topic_share', 'Events and Holidays'),
              ('weighted_promo_signal', 'Promo Content x Engagement'), ('weighted_product_signal', 'Product Content x Engagement'), ('weighted_event_signal', 'Event Content x Engagement')) l(s, label) ON p.signal = s
        WHERE p.location_id = 'ALL' AND p.outcome = 'revenue' AND c.correlation IS NOT NULL""",
    "intent_tags": f"""
        SELECT conv_id, turn, {_intent("'top_items_by_revenue'")} AS intent,
               {_intent("CASE WHEN contains(q, 'by count') THEN 'top_items_by_orders' ELSE 'top_items_by_revenue' END")} AS intent_by_orders FROM asked""",
    "guardrail_tags": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_any('q', w)} THEN '{n}'" for n, w in tagging.GUARDRAIL_WORDS.items()) + " END AS guard FROM asked",
    "ambiguity_tags": f"""
        SELECT conv_id, turn, open_point, CASE WHEN open_point = 'metric_type' OR (open_point = 'time_granularity' AND NOT {_any('q', tagging.TREND_WORDS)}) THEN NULL ELSE open_point END AS open_point_lenient
        FROM (SELECT *, {_OPEN} AS open_point FROM asked)""",
    "driver_features": "SELECT * REPLACE (strftime(business_date, '%Y-%m-%d') AS business_date) FROM r_drivers",
    "standardize": "SELECT location_id, strftime(business_date, '%Y-%m-%d') AS business_date, "
    + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / {f}({c}) OVER (), 6) AS {c}{kind}_z"
        for c in ("order_count", "avg_order_value", "tip_rate") for kind, f in (("", "stddev_pop"), ("_sample", "stddev_samp"))
    )
    + " FROM r_drivers",
    "evidence_level": """
        SELECT location_id, outcome, signal, lag, CASE WHEN r >= 0.35 AND pairs >= 120 THEN 'High' WHEN r >= 0.20 AND pairs >= 75 THEN 'Moderate' ELSE 'Directional' END AS level
        FROM (SELECT *, round(pow(correlation, 2) * 10, 6) AS r FROM e_corr)""",
    "new_files": """
        SELECT order_guid, payment_method, amount, payment_date, store AS location_id, '20010801' AS business_date FROM raw_payments, (VALUES ('store_0'), ('store_1'), ('store_2')) s(store)""",
    "new_orders_clean": """
        SELECT 'store_0' AS location_id, count(DISTINCT order_guid) AS orders, (SELECT count(order_time) FROM v_orders) AS timed, count(*)::BIGINT AS logged_rows FROM raw_orders""",
    "profile_snapshot_append": """
        SELECT CAST(s_suppkey AS VARCHAR) AS account_id, CASE WHEN s_acctbal < 0 THEN CAST(s_suppkey AS VARCHAR) ELSE lower(s_name) END AS account_label,
               CAST(s_nationkey AS BIGINT) AS media_count, strftime(DATE '2001-02-01' + s_nationkey, '%Y-%m-%d') AS snapshot_date, 'run-2' AS source_run_id,
               2 AS logged_rows FROM supplier""",
    "snapshot_append": """
        SELECT 'acct_' || account AS account_id, 'run-2' AS source_run_id, count(*) AS media, CAST(sum(n_chars % 211 + n_chars % 17) AS BIGINT) AS engagement FROM media_base GROUP BY account""",
    "sync_range": """
        SELECT location_id, strftime(strptime(max(business_date) FILTER (file_type = 'CSV'), '%Y%m%d') + INTERVAL 1 DAY, '%Y%m%d') AS start_date, '20010814' AS end_date
        FROM raw_import_log GROUP BY location_id HAVING max(business_date) FILTER (file_type = 'CSV') < '20010814'""",
    "latest_import_date": "SELECT location_id, max(business_date) AS latest_date FROM raw_import_log WHERE file_type = 'API' GROUP BY 1",
    "imported_dates": "SELECT location_id, business_date FROM raw_import_log WHERE file_type = 'CSV'",
    "pending_dates": """
        SELECT location_id, business_date FROM (
            SELECT location_id, strftime(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)), '%Y%m%d') AS business_date FROM placed GROUP BY location_id)
        WHERE (location_id, business_date) NOT IN (SELECT (location_id, business_date) FROM raw_import_log WHERE file_type = 'API')""",
    "unlogged_imports": """
        SELECT location_id, business_date, 'CSV' AS file_type, 'CSV' AS file_name, count(*) AS rows_imported FROM raw_orders
        WHERE (location_id, business_date) NOT IN (SELECT (location_id, business_date) FROM raw_import_log WHERE file_type = 'CSV') GROUP BY 1, 2""",
    "refresh_window": """
        SELECT location_id, CASE WHEN location_id LIKE 'site%' THEN '1999-12-31' ELSE strftime(now - INTERVAL 30 DAY, '%Y-%m-%d') END AS start_date, strftime(now, '%Y-%m-%d') AS end_date FROM t_latest""",
    "backfill_chunks_by_year": _chunk_sql(12),
    "backfill_chunks_by_quarter": _chunk_sql(3),
    "backfill_chunks_by_month": _chunk_sql(1),
}
