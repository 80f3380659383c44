"""Keyword tags of captions and question texts, and topics of captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.functions.columns import contains_any
from saltcellar.operators import topics
from saltcellar.session import settle, stored

# Caption keywords per topic, and the seed words of each topic.
TOPIC_KEYWORDS = {
    "promo_topic": (
        "discount", "deal", "offer", "promo", "promotion", "special", "save", "gift card", "free", "giveaway", "coupon",
        "bundle", "rewards", "limited", "win", "lunch special", "happy hour",
    ),
    "product_topic": (
        "dumpling", "dumplings", "xlb", "xiao long bao", "bao", "bun", "noodle", "noodles", "fried rice", "wonton",
        "potsticker", "scallion pancake", "chili oil", "dan dan", "beef", "shrimp", "pork", "chicken", "milk tea", "menu",
    ),
    "event_topic": (
        "grand opening", "soft opening", "now open", "new location", "holiday", "christmas", "new year", "lunar",
        "valentine", "mother's day", "thanksgiving", "halloween", "anniversary", "event", "festival", "community",
        "catering", "collab",
    ),
}
TOPIC_SEEDS = {
    "promo_topic": ("discount", "deal", "offer", "promo", "promotion", "special", "free", "bundle", "rewards"),
    "product_topic": (
        "dumpling", "dumplings", "xlb", "bao", "noodle", "noodles", "rice", "wonton", "chicken", "pork",
    ),
    "event_topic": ("opening", "holiday", "christmas", "lunar", "event", "festival", "community", "catering"),
}
TOPICS = tuple(TOPIC_KEYWORDS)
KEY = ("account_id", "media_id")
MIN_CAPTIONS = 5

# Question words, checked in this order.
KNOWN_ITEMS = (
    "Pan-Fried Dumplings (6pc)", "Steamed Dumplings (6pc)", "Soup Dumplings (8pc)", "Noodle Bowl - Beef",
    "Wontons in Chili Oil",
)
CATEGORY_WORDS = ("category", "categories")
MIX_WORDS = ("driving", "share", "percent", "percentage", "contribution", "mix")
INTENT_WORDS = {
    "inventory_attention": ("inventory", "stock", "reorder"),
    "review_sentiment": ("review", "rating", "sentiment"),
    "customer_summary": ("customer", "repeat", "loyal"),
    "order_type_mix": ("order type", "delivery", "dine", "takeout"),
    "category_performance": CATEGORY_WORDS,
    "top_items": ("item", "menu", "dish", "popular", "top", "best"),
    "average_order_value": ("average order", "avg order", "aov"),
    "daily_revenue": ("trend", "daily", "over time", "by day"),
}
GUARDRAIL_WORDS = {
    "destructive": (
        "delete", "drop", "truncate", "update", "insert", "alter", "create table", "remove all", "wipe", "erase",
        "destroy", "grant", "revoke",
    ),
    "sql": ("select ", " from ", " where ", " join ", " group by", " union ", "--", "/*", "*/"),
    "pii": (
        "email", "phone", "address", "name", "guest", "customer list", "customer id", "customer_id", "pii",
        "personally identifiable",
    ),
    "row_level": (
        "order id", "order_id", "order guid", "order_guid", "transaction id", "receipt", "raw rows", "raw records",
        "individual orders", "individual transactions", "line items", "show every order", "list all orders",
    ),
}
AMBIGUITY_WORDS = {  # words that raise the question, words that answer it
    "time_granularity": (
        ("trend", "over time", "show", "graph", "chart", "track", "pattern"),
        ("daily", "weekly", "monthly", "by day", "by week", "by month", "day", "week", "month"),
    ),
    "ranking_basis": (("top", "best", "popular", "most"), ("revenue", "sales", "orders", "count", "quantity")),
    "metric_type": (("revenue", "sales", "earnings"), ("total", "subtotal", "net", "gross")),
    "filter_type": (("inventory", "stock"), ("all", "low", "critical", "good", "status")),
}
TREND_WORDS = ("trend", "over time", "graph", "chart", "track", "pattern")


def keyword_flags(caption: Column) -> dict[str, Column]:
    """A 0/1 flag per topic: does the whole caption hold one of its keywords."""
    low = F.lower(F.coalesce(caption, F.lit("")))
    return {topic: contains_any(low, words).cast("int") for topic, words in TOPIC_KEYWORDS.items()}


def keyword_topics(media: DataFrame, caption: str = "caption") -> DataFrame:
    return media.withColumns(keyword_flags(F.col(caption)))


def _first_match(rules: list[tuple[str, Column]], otherwise: str | None) -> Column:
    name, hit = rules[0]
    chain = F.when(hit, name)
    for name, hit in rules[1:]:
        chain = chain.when(hit, name)
    return chain.otherwise(otherwise) if otherwise is not None else chain


def intent_tag(question: Column, by_orders: Column | None = None) -> Column:
    """The kind of report a question asks for. `by_orders` ranks items by orders, not revenue."""
    q = F.lower(question)
    items = "top_items_by_revenue"
    rules = [
        ("category_revenue_mix", contains_any(q, CATEGORY_WORDS) & contains_any(q, MIX_WORDS)),
        ("specific_item_performance", contains_any(q, [item.lower() for item in KNOWN_ITEMS])),
    ]
    for name, words in INTENT_WORDS.items():
        hit = contains_any(q, words)
        if name == "top_items":
            if by_orders is not None:
                rules.append(("top_items_by_orders", hit & by_orders))
            name = items
        rules.append((name, hit))
    return _first_match(rules, "sales_summary")


def guardrail_tag(question: Column) -> Column:
    """The first guard a question runs into, NULL for none."""
    q = F.lower(question)
    return _first_match([(name, contains_any(q, words)) for name, words in GUARDRAIL_WORDS.items()], None)


def ambiguity_tag(question: Column) -> Column:
    """What a question leaves open: the first pattern raised and not answered, NULL for none."""
    q = F.lower(F.trim(question))
    return _first_match(
        [
            (name, contains_any(q, raised) & ~contains_any(q, answered))
            for name, (raised, answered) in AMBIGUITY_WORDS.items()
        ],
        None,
    )


def ambiguity_tag_lenient(question: Column) -> Column:
    """As `ambiguity_tag`, but the revenue metric is never asked for and the time step only
    when the question names a trend."""
    tag, q = ambiguity_tag(question), F.lower(question)
    return F.when(
        (tag == "metric_type") | ((tag == "time_granularity") & ~contains_any(q, TREND_WORDS)), F.lit(None)
    ).otherwise(tag)


def _topic_parts(media: DataFrame, neighbours: int, least_size: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with (key, keyword flags, topic, category), and the topics' words; no words below five usable captions.

    Captions are read once: rows keep their text's hash and flags, and texts move only to be made one of equal ones.
    """
    text = F.trim(F.regexp_replace(F.coalesce("caption", F.lit("")), r"#\w+", ""))
    flags = [flag.alias(name) for name, flag in keyword_flags(F.col("caption")).items()]
    kept = stored(media.select(*KEY, *flags, text.alias("text")), "captions")
    texts = kept.select(*KEY, *TOPICS, F.md5("text").alias("hash"))
    usable = kept.filter(F.col("text") != "")
    if usable.count() < MIN_CAPTIONS:
        return texts.withColumns({"topic": F.lit(None).cast("int"), "category": F.lit(None).cast("string")}), None
    assigned, terms = topics.caption_topics(usable.groupBy("text").agg(F.count(F.lit(1)).alias("copies")), neighbours, least_size)
    words = settle(topics.top_words(topics.topic_terms(assigned, terms)))
    named = words.select(F.col("topic").alias("of"), topics.category_of(F.col("words"), TOPIC_SEEDS).alias("category"))
    rows = texts.join(assigned.withColumnRenamed("text", "hash"), "hash", "left")
    return rows.join(named, F.col("topic") == F.col("of"), "left").drop("of", "hash"), words


def topic_model(media: DataFrame, neighbours: int = topics.NEIGHBOURS, least_size: int = topics.LEAST_SIZE) -> DataFrame:
    """Topic flags from topics found in the captions, keyword flags where they say nothing.

    Hashtags and English stop words are taken out; captions are clustered by density over their one- to three-word terms, so the
    number of topics follows from the data. A topic belongs to the group with most seed words among its eight heaviest terms.
    Captions left out as noise, and those of topics without a seed word, take the keyword flags; below five captions only
    keywords are used. Rows are (account_id, media_id) as given; equal captions share a topic.
    """
    rows, _ = _topic_parts(media, neighbours, least_size)
    found = F.col("category").isNotNull()
    return rows.select(
        *KEY, "topic", *[F.when(found, (F.col("category") == n).cast("int")).otherwise(F.col(n)).alias(n) for n in TOPICS]
    )


def topic_table(media: DataFrame, neighbours: int = topics.NEIGHBOURS, least_size: int = topics.LEAST_SIZE) -> DataFrame:
    """topic, category, size and the five heaviest terms of each topic, and one row without topic for the captions left out."""
    rows, words = _topic_parts(media, neighbours, least_size)
    words = media.sparkSession.createDataFrame([], "topic int, words array<string>") if words is None else words
    return topics.topic_summary(rows, words)


def keyword_topic_table(media: DataFrame, stop: Sequence[str] | None = None) -> DataFrame:
    """The same table with the first keyword group of a caption, hashtags taken out, as its topic."""
    text = F.trim(F.regexp_replace(F.coalesce("caption", F.lit("")), r"#\w+", ""))
    flags = keyword_flags(F.col("text"))
    first = _first_match([(name, flags[name] == 1) for name in TOPICS], None)
    rows = stored(media.select(text.alias("text")).select("text", first.alias("topic")), "captions")
    usable = rows.filter("text <> ''")
    texts = usable.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    assigned = usable.filter("topic IS NOT NULL").select(F.md5("text").alias("text"), "topic").distinct()
    words = topics.top_words(topics.topic_terms(assigned, topics.term_table(texts, stop, lists=True)))
    return topics.topic_summary(rows.select("topic", F.col("topic").alias("category")), words)
