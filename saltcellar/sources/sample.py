"""The warehouse tables derived from the star-schema sample parquet files.

Amounts are whole cents until the last step, so each row carries exact cents. Derived rows
include repeated orders, refunds, blank names and categories, and unreadable times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signs put into some item names so that name folding has work to do.
NOUN_SIGNS = {"ring": "环", "gear": "齿轮", "bolt": "螺栓"}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(column: str, per: int = 1, unit: int = 1) -> str:
    """SQL for `per`/`unit` of an amount in whole cents, half up."""
    whole = f"CAST(round({column} * 100) AS BIGINT)"
    return whole if per == unit else f"(({whole} * {per} + {unit // 2}) div {unit})"


def _amount(cents: str) -> Column:
    return F.expr(f"({cents}) / 100.0D")


# SQL for a line's price (a thousandth of the list price) and its discount and tax, in cents.
LINE_PRICE = _cents("l_extendedprice", 1, 1000)
LINE_DISCOUNT = (
    f"CASE WHEN l_returnflag = 'R' THEN ({LINE_PRICE} * CAST(round(l_discount * 100) AS BIGINT) + 50) div 100 ELSE 0L END"
)
LINE_TAX = f"(({LINE_PRICE} * CAST(round(l_tax * 100) AS BIGINT) + 50) div 100)"


def customer_locations(spark: SparkSession, folder: str) -> DataFrame:
    """c_custkey, c_name, c_mktsegment and the location of the customer."""
    name = F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("_")))
    location = F.when(
        F.col("r_name").isin("AFRICA", "EUROPE"), F.concat(F.lit("site_"), F.col("r_regionkey").cast("string"))
    ).otherwise(F.concat(F.lit("demo_"), name))
    places = (
        _table(spark, folder, "nation")
        .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", location.alias("location_id"))
    )
    return (
        _table(spark, folder, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "c_mktsegment", "location_id")
    )


def _share_of(key: str, share: int | None, shares: int) -> Column:
    """Whether a row's order belongs to a share of all orders; every row does to None."""
    return F.lit(True) if share is None else F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(shares)) == share


def _placed_orders(spark: SparkSession, folder: str, share: int | None = None, shares: int = 1) -> DataFrame:
    return (
        _table(spark, folder, "orders")
        .filter(_share_of("o_orderkey", share, shares))
        .join(customer_locations(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("order_guid", F.col("o_orderkey").cast("string"))
        .withColumn("business_date", F.date_format("o_orderdate", "yyyyMMdd"))
    )


def _order_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("amounts_of")).agg(
        F.expr(f"sum({LINE_PRICE})").alias("subtotal"),
        F.expr(f"sum({LINE_DISCOUNT})").alias("discount"),
        F.expr(f"sum({LINE_TAX})").alias("tax"),
    )


def _clock_text() -> Column:
    hour, minute = "pmod(CAST(o_totalprice AS BIGINT), 14) + 8", "pmod(CAST(o_totalprice AS BIGINT), 60)"
    iso = f"concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T', lpad({hour}, 2, '0'), ':', lpad({minute}, 2, '0')"
    return F.expr(
        f"""CASE WHEN o_orderstatus = 'F' THEN concat(date_format(o_orderdate, 'M/d/yy'), ' ',
                 CASE WHEN {hour} > 12 THEN {hour} - 12 ELSE {hour} END, ':', lpad({minute}, 2, '0'),
                 CASE WHEN {hour} >= 12 THEN ' PM' ELSE ' AM' END)
            WHEN o_orderstatus = 'O' THEN {iso}, ':30.250Z')
            WHEN o_orderpriority = '5-LOW' THEN {iso}, ':00+0000')
            ELSE {iso}, ':00Z') END"""
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Raw orders. Those with status P arrive twice: the later copy has no tip. They lie together by order_guid after their join."""
    placed = _placed_orders(spark, folder).join(
        _order_amounts(spark, folder), F.col("order_guid") == F.col("amounts_of"), "left"
    )
    kind = F.expr(
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'DELIVERY' WHEN '2-HIGH' THEN 'Take Out' WHEN '3-MEDIUM' THEN 'Dine In'
           WHEN '4-NOT SPECIFIED' THEN 'UNKNOWN' ELSE CASE WHEN o_orderstatus <> 'P' THEN 'API' END END"""
    )
    amounts = placed.select(
        "order_guid", "location_id", "business_date", "o_orderstatus", "o_orderdate",
        _clock_text().alias("order_time"),
        kind.alias("order_type"),
        F.expr("coalesce(subtotal, 0L)").alias("sub"),
        F.expr("coalesce(discount, 0L)").alias("disc"),
        F.expr("coalesce(tax, 0L)").alias("tax"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 0L ELSE (coalesce(subtotal, 0L) * 15 + 50) div 100 END").alias("tip"),
        F.expr("CASE WHEN o_totalprice < 3000 THEN -1 ELSE 1 END").alias("sign"),
        F.expr("explode(CASE WHEN o_orderstatus = 'P' THEN array(0, 1) ELSE array(0) END)").alias("copy"),
    )
    return amounts.select(
        F.col("order_guid").alias("order_id"), "location_id", "business_date", "order_guid", "order_time",
        F.expr("CASE WHEN copy = 1 THEN 'Takeout' ELSE order_type END").alias("order_type"),
        _amount("(sub - disc + tax + tip) * sign").alias("total_amount"),
        _amount("sub").alias("subtotal"),
        _amount("tax").alias("tax_amount"),
        _amount("CASE WHEN copy = 1 THEN 0L ELSE tip END").alias("tip_amount"),
        _amount("disc").alias("discount_amount"),
        F.expr("CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(1 + copy)").alias("created_at"),
    )


def _item_name() -> Column:
    signs = " ".join(f"WHEN '{word}' THEN '{sign}'" for word, sign in NOUN_SIGNS.items())
    sign = f"CASE element_at(split(p_name, ' '), -1) {signs} END"
    return F.expr(
        f"""CASE WHEN p_type = 'PROMO' AND p_size = 13 THEN '' WHEN {sign} IS NULL THEN p_name
            WHEN p_size >= 40 THEN concat({sign}, ' ', p_name, ' (8)') WHEN p_size >= 20 THEN concat(p_name, '  ⭐ ', {sign})
            WHEN p_size >= 3 THEN concat(p_name, ' ', {sign}) ELSE {sign} END"""
    )


def _kind_name() -> Column:
    return F.expr("CASE p_type WHEN 'SMALL' THEN 'Beverages' WHEN 'LARGE' THEN 'Wine' ELSE p_type END")


def _lines(spark: SparkSession, folder: str, by_order: Column | None = None, share: int | None = None, shares: int = 1) -> DataFrame:
    """Lines with their part and order, of one share of the orders or all. `by_order` meets the orders by another name of their key, by which
    later steps group."""
    parts = _table(spark, folder, "part").select(
        "p_partkey", "p_size", "p_retailprice", _item_name().alias("item_name"), _kind_name().alias("kind")
    )
    placed = _placed_orders(spark, folder, share, shares).select("o_orderkey", "order_guid", "location_id", "business_date")
    return (
        _table(spark, folder, "lineitem")
        .filter(_share_of("l_orderkey", share, shares))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey") if by_order is None else by_order)
    )


def _quantity() -> Column:
    return F.expr("CASE WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN 0L ELSE CAST(l_quantity AS BIGINT) END")


def order_items(spark: SparkSession, folder: str, share: int | None = None, shares: int = 1) -> DataFrame:
    """Raw lines, of one share of the orders or all. They lie together by order_guid after their join, so grouping by order moves no line again."""
    return _lines(spark, folder, F.col("l_orderkey").cast("string") == F.col("order_guid"), share, shares).select(
        "order_guid",
        "item_name",
        F.expr("CASE WHEN l_returnflag = 'A' THEN '' ELSE kind END").alias("category"),
        _quantity().alias("quantity"),
        _amount(LINE_PRICE).alias("prediscount_total"),
        _amount(LINE_PRICE).alias("total_price"),
        "location_id",
        "business_date",
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    method = (
        F.when(F.col("c_mktsegment") == "BUILDING", "CREDIT")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "CASH")
        .when(F.col("c_mktsegment") == "MACHINERY", "GIFTCARD")
        .otherwise("UNKNOWN")
    )
    return _placed_orders(spark, folder).select(
        "order_guid",
        method.alias("payment_method"),
        _amount(_cents("o_totalprice", 1, 1000)).alias("amount"),
        _clock_text().alias("payment_date"),
        "location_id",
        "business_date",
    )


def _contact() -> dict[str, Column]:
    email = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
    digits = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    segment = F.col("c_mktsegment")
    return {
        "customer_email": F.when(segment.isin("BUILDING", "AUTOMOBILE"), email)
        .when(segment == "MACHINERY", F.concat(F.lit(" "), F.upper(email), F.lit("  ")))
        .when(segment == "HOUSEHOLD", F.lit("")),
        "customer_phone": F.when(
            segment.isin("HOUSEHOLD", "AUTOMOBILE"),
            F.concat(F.lit("(555) "), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 4)),
        ).when(segment == "FURNITURE", F.lit("  ")),
        "first_name": F.when(segment != "FURNITURE", F.concat(F.lit("Guest "), F.col("c_custkey").cast("string"))),
        "last_name": F.lit(None).cast("string"),
    }


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _placed_orders(spark, folder).select(
        "order_guid", "location_id", "business_date", *[c.alias(k) for k, c in _contact().items()]
    )


# The two days on which stock was taken.
SNAPSHOT_DAYS = ("20010701", "20010801")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per location, item and stock day, from the items each location sold."""
    kinds = (
        _lines(spark, folder)
        .filter(F.col("item_name") != "")
        .groupBy("location_id", "item_name")
        .agg(
            F.min("kind").alias("category"),
            F.min("p_size").alias("low"),
            F.max("p_size").alias("high"),
            F.min("p_retailprice").alias("price"),
        )
    )
    stock = F.col("low").cast("double") - F.when(F.col("snapshot_date") == SNAPSHOT_DAYS[0], 1.0).otherwise(3.0)
    level = F.col("high").cast("double") / 8
    status = F.when(stock <= 1, "critical").when(stock < level, "low").otherwise("good")
    return (
        kinds.withColumn("snapshot_date", F.explode(F.array(*[F.lit(d) for d in SNAPSHOT_DAYS])))
        .select(
            "location_id",
            "item_name",
            F.when(F.col("high") >= 20, F.col("category")).otherwise("").alias("category"),
            stock.alias("current_stock"),
            level.alias("reorder_level"),
            F.when(~F.col("item_name").startswith("new"), _amount(_cents("price", 4, 10000))).alias("unit_cost"),
            F.lit(None).cast("string").alias("last_ordered"),
            "snapshot_date",
            status.alias("status"),
        )
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    place = (
        F.when(F.col("lang") == "de", "demo_america")
        .when(F.col("lang") == "en", "demo_asia")
        .when(F.col("lang") == "es", "demo_middle_east")
        .otherwise("site_0")
    )
    mood = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(
        F.col("quality") == 0, "neutral"
    )
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("n_chars") % 200).cast("int"))
    return (
        _table(spark, folder, "documents")
        .join(_table(spark, folder, "labels"), "doc_id", "left")
        .select(
            F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("review_id"),
            place.alias("location_id"),
            F.col("doc_id").cast("string").alias("order_guid"),
            F.date_format(day, "yyyyMMdd").alias("review_date"),
            (F.col("n_chars") % 5 + 1).alias("rating"),
            F.col("text").alias("review_text"),
            mood.alias("sentiment"),
            F.col("source").alias("category"),
        )
    )


def time_entries(spark: SparkSession, folder: str) -> DataFrame:
    place = (
        F.when(F.col("event_type") == "click", "demo_america")
        .when(F.col("event_type") == "view", "demo_asia")
        .when(F.col("event_type") == "purchase", "demo_middle_east")
        .when(F.col("event_type") == "signup", "site_0")
        .otherwise("site_3")
    )
    worked = f"least({_cents('value', 1, 10)}, 1400L)"
    cash, card = _cents("value", 5, 100), _cents("value", 10, 100)
    hours = _amount(worked)
    return _table(spark, folder, "events").select(
        place.alias("location_id"),
        F.date_format("ts", "yyyyMMdd").alias("business_date"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("employee_name"),
        F.col("event_type").alias("job_title"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("clock_in_time"),
        F.lit(None).cast("string").alias("clock_out_time"),
        hours.alias("total_hours"),
        hours.alias("payable_hours"),
        _amount(f"least({worked}, 800L)").alias("regular_hours"),
        _amount(f"greatest({worked} - 800L, 0L)").alias("overtime_hours"),
        _amount(cash).alias("cash_tips"),
        _amount(card).alias("non_cash_tips"),
        F.lit(0.0).alias("total_gratuity"),
        _amount(f"{cash} + {card}").alias("total_tips"),
        F.lit(15.0).alias("wage"),
        (hours * 60).cast("long").alias("duration_minutes"),
    )


def import_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per location, day and source, as an importer would have left it."""
    source = F.when(F.col("o_orderstatus") == "F", "CSV").otherwise("API")
    rows = _placed_orders(spark, folder).groupBy("location_id", "business_date", source.alias("file_type"))
    return rows.agg(F.count(F.lit(1)).alias("rows_imported")).select(
        F.concat_ws("-", "location_id", "business_date", "file_type").alias("import_id"),
        "location_id",
        "business_date",
        "file_type",
        F.concat(F.col("file_type"), F.lit(".orders")).alias("file_name"),
        "rows_imported",
        (F.to_timestamp("business_date", "yyyyMMdd") + F.expr("INTERVAL 1 DAY")).alias("import_timestamp"),
    )


def _media_source(spark: SparkSession, folder: str) -> DataFrame:
    tail = (
        F.when(F.col("source").endswith("1"), " Lunch Special today #deal")
        .when(F.col("source").endswith("2"), " New Location: grand opening")
        .when(F.col("source").endswith("3"), " Pork dumplings and milk tea #menu")
        .otherwise("")
    )
    day = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("n_chars") % 500).cast("int"))
    clock = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:15:00"))
    stamp = (
        F.when(F.col("lang") == "de", F.concat(clock, F.lit("+0000")))
        .when(F.col("lang") == "en", F.concat(clock, F.lit("Z")))
        .when(F.col("lang") == "es", F.concat(clock, F.lit("+02:00")))
        .when(F.col("n_chars") % 2 == 0, F.lit("not a time"))
        .otherwise(F.concat(clock, F.lit(".125+0000")))
    )
    kind = (
        F.when(F.col("source").endswith("1"), "VIDEO")
        .when(F.col("source").endswith("2"), "CAROUSEL_ALBUM")
        .when(F.col("source").endswith("4"), "STORY")
        .otherwise("IMAGE")
    )
    return _table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("media_id"),
        F.col("source").alias("account"),
        F.concat(F.col("text"), tail).alias("caption"),
        kind.alias("media_type"),
        F.when(F.col("source").endswith("5"), "REELS").otherwise("FEED").alias("media_product_type"),
        stamp.alias("timestamp"),
        F.col("lang"),
        F.col("n_chars"),
    )


def media_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Raw media items; albums carry two children, like counts come as text in one language."""
    likes = F.col("n_chars") % 211
    children = F.when(
        F.col("media_type") == "CAROUSEL_ALBUM",
        F.array(
            F.struct(
                F.concat(F.col("media_id"), F.lit("-1")).alias("id"),
                F.lit("IMAGE").alias("media_type"),
                F.col("timestamp"),
                F.lit(" ").alias("media_url"),
                F.lit(None).cast("string").alias("thumbnail_url"),
            ),
            F.struct(
                F.concat(F.col("media_id"), F.lit("-2")).alias("id"),
                F.lit("VIDEO").alias("media_type"),
                F.lit(None).cast("string").alias("timestamp"),
                F.concat(F.lit("https://media.example/"), F.col("media_id")).alias("media_url"),
                F.lit(None).cast("string").alias("thumbnail_url"),
            ),
        ),
    )
    metric = lambda name, value: F.struct(
        F.lit(name).alias("name"), value.cast("long").alias("value"),
        F.lit(None).cast("array<struct<value:bigint>>").alias("values"),
    )
    metric_series = lambda name, value: F.struct(
        F.lit(name).alias("name"), F.lit(None).cast("long").alias("value"),
        F.array(F.struct(value.cast("long").alias("value"))).alias("values"),
    )
    return _media_source(spark, folder).select(
        F.col("media_id").alias("id"),
        "account",
        "caption",
        "media_type",
        "media_product_type",
        "timestamp",
        F.lit("https://social.example/p").alias("permalink"),
        F.lit(" ").alias("media_url"),
        F.lit(None).cast("string").alias("thumbnail_url"),
        F.when(F.col("lang") != "es", likes.cast("string")).alias("like_count"),
        likes.cast("string").alias("likes"),
        (F.col("n_chars") % 17).cast("string").alias("comments_count"),
        F.when(F.col("lang") == "fr", F.lit("n/a")).otherwise((F.col("n_chars") % 1009).cast("string")).alias("views"),
        F.array(
            metric("reach", F.col("n_chars") % 3001),
            metric_series("saved", F.col("n_chars") % 7),
            metric("shares", F.when(F.col("lang") != "de", F.col("n_chars") % 5)),
        ).alias("insights"),
        F.struct(children.alias("data")).alias("children"),
    )


def profile_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Raw account profiles, from the suppliers."""
    return _table(spark, folder, "supplier").select(
        F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("id"),
        F.when(F.col("s_acctbal") < 0, F.lit(" ")).otherwise(F.lower("s_name")).alias("username"),
        F.col("s_name").alias("name"),
        F.lit("").alias("biography"),
        F.lit("BUSINESS").alias("account_type"),
        F.col("s_nationkey").cast("string").alias("media_count"),
        F.when(F.col("s_acctbal") < 0, F.lit("many")).otherwise(F.floor("s_acctbal").cast("string")).alias("followers_count"),
        F.lit(None).cast("string").alias("follows_count"),
        F.lit(None).cast("string").alias("profile_picture_url"),
        F.concat(
            F.date_format(F.date_add(F.lit("2001-01-31").cast("date"), F.col("s_nationkey")), "yyyy-MM-dd"),
            F.lit("T23:30:00-0200"),
        ).alias("snapshot_at"),
    )


def media_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over every media item; the later one has the grown counters."""
    runs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f"run-{n}").alias("id")) for n in (1, 2)])
    n = F.col("run.n")
    posted = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("n_chars") % 500).cast("int"))
    likes = F.col("n_chars") % 211 * n
    comments = F.col("n_chars") % 17 + n
    return _media_source(spark, folder).withColumn("run", F.explode(runs)).select(
        F.concat(F.lit("acct_"), F.col("account")).alias("account_id"),
        F.col("account").alias("account_label"),
        F.col("account").alias("username"),
        "media_id",
        F.when(F.col("lang") == "de", F.lit("")).otherwise(F.col("caption")).alias("caption"),
        F.when(F.col("media_type") == "CAROUSEL_ALBUM", "CAROUSEL").otherwise(F.col("media_type")).alias("media_type"),
        "media_product_type",
        F.lit(None).cast("string").alias("permalink"),
        F.lit(None).cast("string").alias("media_url"),
        F.lit(None).cast("string").alias("thumbnail_url"),
        F.col("timestamp").alias("posted_at_raw"),
        F.when(F.col("lang") == "en", F.col("timestamp")).alias("posted_at_utc"),
        F.when((F.col("lang") != "fr") | (F.col("n_chars") % 2 == 1), F.date_format(posted, "yyyyMMdd")).alias("posted_date_utc"),
        likes.alias("likes"),
        comments.alias("comments_count"),
        F.when(F.col("lang") != "fr", F.col("n_chars") % 1009).alias("views"),
        F.when(F.col("lang") != "fr", F.col("n_chars") % 3001).alias("reach"),
        (F.col("n_chars") % 7).alias("saved"),
        F.when(F.col("lang") != "es", F.col("n_chars") % 5).alias("shares"),
        F.when(F.col("lang") == "de", likes + comments + 3).alias("total_interactions"),
        F.lit(None).cast("string").alias("children_json"),
        F.lit(0).cast("long").alias("child_count"),
        F.col("run.id").alias("source_run_id"),
        (F.lit("2001-08-01").cast("timestamp") + F.make_dt_interval(days=n)).alias("created_at"),
    )


def profile_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Three snapshots per account in three text forms of time."""
    runs = F.array(
        F.struct(F.lit(1).alias("n"), F.lit("2001-08-01T23:30:00-02:00").alias("at"), F.lit("20010801").alias("day")),
        F.struct(F.lit(2).alias("n"), F.lit("2001-08-02T10:00:00.500Z").alias("at"), F.lit("20010802").alias("day")),
        F.struct(F.lit(3).alias("n"), F.lit("2001-08-03T08:00:00+0000").alias("at"), F.lit("bad").alias("day")),
    )
    n = F.col("run.n")
    return (
        _table(spark, folder, "supplier")
        .withColumn("run", F.explode(runs))
        .filter((n < 3) | (F.col("s_acctbal") > 0))
        .select(
            F.col("s_suppkey").cast("string").alias("account_id"),
            F.col("s_name").alias("account_label"),
            F.col("s_name").alias("username"),
            F.col("s_name").alias("name"),
            F.lit(None).cast("string").alias("biography"),
            F.lit("BUSINESS").alias("account_type"),
            F.col("s_nationkey").cast("long").alias("media_count"),
            (F.floor("s_acctbal") * n).cast("long").alias("followers_count"),
            F.lit(None).cast("long").alias("follows_count"),
            F.lit(None).cast("string").alias("profile_picture_url"),
            F.lit("UTC").alias("local_timezone"),
            F.col("run.at").alias("snapshot_at"),
            F.col("run.day").alias("snapshot_date"),
            F.concat(F.lit("run-"), n.cast("string")).alias("source_run_id"),
            (F.lit("2001-08-01").cast("timestamp") + F.make_dt_interval(days=n)).alias("created_at"),
        )
    )


def order_payload(spark: SparkSession, folder: str, share: int | None = None, shares: int = 1) -> DataFrame:
    """Orders as nested documents: one check per line status, one selection per line. The shares of the orders, by hash of their key, hold
    all of them together, each with all its lines."""
    contact = _contact()
    selection = F.struct(
        (F.col("l_returnflag") == "N").alias("voided"),
        F.col("item_name").alias("displayName"),
        F.when(F.col("l_linenumber") != 6, _quantity()).alias("quantity"),
        _amount(LINE_PRICE).alias("preDiscountPrice"),
        F.when(F.col("l_linenumber") != 5, _amount(f"{LINE_PRICE} - {LINE_DISCOUNT}")).alias("price"),
        F.when(F.col("l_returnflag") != "A", F.struct(F.col("kind").alias("name"))).alias("salesCategory"),
        F.when(F.col("l_linenumber") <= 2, F.array(F.struct(F.lit("extra").alias("displayName")))).alias("modifiers"),
    )
    checks = (
        _lines(spark, folder, share=share, shares=shares)
        .groupBy("l_orderkey", "l_linestatus")
        .agg(
            F.collect_list(selection).alias("selections"),
            F.expr(f"sum({LINE_PRICE})").alias("amount"),
            F.expr(f"sum({LINE_DISCOUNT})").alias("discount"),
            F.expr(f"sum({LINE_TAX})").alias("tax"),
        )
    )
    total = _amount("amount - discount + tax")
    documents = (
        _placed_orders(spark, folder, share, shares)
        .join(checks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_orderkey")
        .agg(
            F.first("business_date").alias("day"),
            F.first("location_id").alias("location_id"),
            F.first(_clock_text()).alias("openedDate"),
            F.first("o_orderpriority").alias("priority"),
            F.first("o_orderstatus").alias("status"),
            F.first("o_totalprice").alias("o_totalprice"),
            F.collect_list(
                F.when(
                    F.col("l_linestatus").isNotNull(),
                    F.struct(
                        ((F.col("l_linestatus") == "F") & (F.col("o_orderpriority") == "2-HIGH")).alias("voided"),
                        total.alias("totalAmount"),
                        _amount("amount").alias("amount"),
                        F.when(F.col("tax") > 0, _amount("tax")).alias("taxAmount"),
                        F.array(
                            F.struct(
                                F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("type"),
                                total.alias("amount"),
                                F.when(
                                    F.col("o_orderstatus") != "F",
                                    _amount("(amount * 15 + 50) div 100"),
                                ).alias("tipAmount"),
                                F.lit("2001-08-01").alias("paidDate"),
                            )
                        ).alias("payments"),
                        F.when(
                            F.col("discount") > 0,
                            F.array(F.struct(_amount("discount").alias("discountAmount"))),
                        ).alias("appliedDiscounts"),
                        F.col("selections"),
                        F.struct(
                            contact["customer_email"].alias("email"),
                            contact["customer_phone"].alias("phone"),
                            contact["first_name"].alias("firstName"),
                            contact["last_name"].alias("lastName"),
                        ).alias("customer"),
                        F.when(F.col("l_linestatus") == "O", F.struct(F.col("c_name").alias("guid"))).alias("employee"),
                        F.when(
                            (F.col("l_linestatus") == "F") & (F.col("o_orderstatus") == "P"),
                            F.struct(F.col("c_name").alias("guid")),
                        ).alias("server"),
                    ),
                )
            ).alias("checks"),
        )
    )
    return documents.select(
        "location_id",
        F.when(F.col("o_totalprice") >= 2000, F.col("o_orderkey").cast("string")).alias("guid"),
        F.col("day").cast("long").alias("businessDate"),
        "openedDate",
        F.when(F.col("priority") != "4-NOT SPECIFIED", F.col("priority")).alias("source"),
        ((F.col("status") == "F") & (F.col("priority") == "5-LOW")).alias("voided"),
        F.when(F.col("status") != "O", F.struct(F.lower("priority").alias("name"))).alias("diningOption"),
        "checks",
    )


def menu_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Menus as nested documents: one per hundred parts, groups by brand."""
    item = F.struct(
        F.when(F.col("p_size") != 50, F.col("p_name")).alias("name"),
        F.when(F.col("p_size") != 49, F.col("p_retailprice")).alias("price"),
    )
    menu = F.floor(F.col("p_partkey") / 100)
    groups = _table(spark, folder, "part").groupBy(menu.alias("menu"), "p_brand").agg(
        F.collect_list(item).alias("menuItems")
    )
    return (
        groups.groupBy("menu")
        .agg(F.collect_list(F.struct(F.col("p_brand").alias("name"), F.col("menuItems"))).alias("menuGroups"))
        .select(F.array(F.struct("menuGroups")).alias("menus"))
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Question texts: the user turns, each with a business question after it."""
    endings = [
        "", " What drives category share?", " stock to reorder?", " Average rating per review",
        " repeat customers", " delivery or dine in", " sales by category", " best dishes", " what is our AOV",
        " daily trend of revenue", " delete all orders", " select x from y", " customer email list",
        " show every order", " Soup Dumplings (8pc) sold", " top sellers by count", " show stock status",
    ]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.length("text") % len(endings) + 1).cast("int"))
    return (
        _table(spark, folder, "conversations")
        .filter(F.col("role") == "user")
        .select("conv_id", "turn", F.concat(F.col("text"), ending).alias("question"))
    )
