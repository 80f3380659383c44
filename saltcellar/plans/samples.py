"""The warehouse tables and clean views over one sample folder, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property
from itertools import chain, repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltcellar.operators import customers, menu, views
from saltcellar.schemas import MEDIA_PAYLOAD, MENU_PAYLOAD, ORDER_PAYLOAD, PROFILE_PAYLOAD
from saltcellar.session import prepare, remove_at_exit, scratch_path, shuffles_dropped
from saltcellar.sources import sample, sinks
from saltcellar.sources.files import read_payload

# Stored views and landed payloads of this application: (application, folder, name) -> path.
_STORED: dict[tuple[str, str, str], str] = {}

# Order payloads are landed, and views of lines stored, in at most so many shares of the orders, of about so many lines.
ORDER_SHARES, SHARE_LINES = 8, 2_000_000


# Table names of the named questions, and the sample table behind each.
QUESTION_TABLES = {
    "orders": "raw_orders", "order_items": "raw_items", "orders_clean": "stored_orders",
    "order_items_clean": "stored_items", "inventory": "inventory", "reviews": "reviews",
    "payments": "raw_payments", "customer_profiles": "profiles", "customer_orders": "raw_customers",
    "customer_orders_masked": "stored_masked",
}


class QuestionTables(Mapping):
    """Tables by question name, built when asked for."""

    def __init__(self, samples: "Samples"):
        self._samples = samples

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self._samples, QUESTION_TABLES[name])

    def __iter__(self):
        return iter(QUESTION_TABLES)

    def __len__(self) -> int:
        return len(QUESTION_TABLES)


class Samples:
    """Nothing is read until an operator's result is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def _raw(self, build) -> DataFrame:
        return build(self.spark, self.folder)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    raw_orders = cached_property(lambda self: self._raw(sample.orders))
    raw_items = cached_property(lambda self: self._raw(sample.order_items))
    raw_payments = cached_property(lambda self: self._raw(sample.payments))
    raw_customers = cached_property(lambda self: self._raw(sample.customer_orders))
    inventory = cached_property(lambda self: self._raw(sample.inventory))
    reviews = cached_property(lambda self: self._raw(sample.reviews))
    labor = cached_property(lambda self: self._raw(sample.time_entries))
    import_log = cached_property(lambda self: self._raw(sample.import_log))
    media_snapshots = cached_property(lambda self: self._raw(sample.media_snapshots))
    profile_snapshots = cached_property(lambda self: self._raw(sample.profile_snapshots))
    order_payload = cached_property(lambda self: self._raw(sample.order_payload))
    menu_payload = cached_property(lambda self: self._raw(sample.menu_payload))
    media_payload = cached_property(lambda self: self._raw(sample.media_payload))
    profile_payload = cached_property(lambda self: self._raw(sample.profile_payload))
    questions = cached_property(lambda self: self._raw(sample.questions))

    name_map = cached_property(lambda self: views.menu_canonical_map(self.raw_items, self.inventory))
    orders = cached_property(lambda self: views.orders_clean(self.raw_orders))
    items = cached_property(lambda self: views.order_items_clean(self.raw_items, self.stored_map))
    payments = cached_property(lambda self: views.payments_clean(self.raw_payments))
    daily = cached_property(lambda self: views.daily_sales(self.stored_orders))
    masked = cached_property(lambda self: views.customers_masked(self.raw_customers))
    media = cached_property(lambda self: views.media_current(self.media_snapshots))

    def _stored(self, view: str) -> DataFrame:
        """The view written once as a table, as the reports find it in production.

        Reports scan stored views several times; each scan then reads its own columns only.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, view)
        if key not in _STORED:
            path = scratch_path(self.spark, view)
            for mode, rows in zip(chain(["overwrite"], repeat("append")), self._in_shares(view)):
                with shuffles_dropped(self.spark):
                    sinks.write_table(rows, path, mode, (), ("location_id", "business_date", "order_guid"), compression="zstd")
            remove_at_exit(self.spark, path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    shares = cached_property(lambda self: max(1, min(ORDER_SHARES, -(-self.table("lineitem").count() // SHARE_LINES))))

    def _in_shares(self, view: str) -> Iterator[DataFrame]:
        """A view of lines by one share of the orders after another, as its steps stay within an order; other views at once."""
        if view not in ("items", "gold") or self.shares == 1:
            yield getattr(self, view)
            return
        for share in range(self.shares):
            if view == "items":
                yield views.order_items_clean(sample.order_items(self.spark, self.folder, share, self.shares), self.stored_map)
            else:
                some = [df.filter(menu.in_share(share, self.shares)) for df in (self.stored_items, self.stored_orders)]
                yield menu.item_gold(*some, self.stored_inventory)

    stored_orders = cached_property(lambda self: self._stored("orders"))
    stored_items = cached_property(lambda self: self._stored("items"))
    stored_masked = cached_property(lambda self: self._stored("masked"))
    stored_inventory = cached_property(lambda self: self._stored("inventory"))
    stored_gold = cached_property(lambda self: self._stored("gold"))
    stored_map = cached_property(lambda self: self._stored("name_map"))

    @cached_property
    def gold(self) -> DataFrame:
        return menu.item_gold(self.stored_items, self.stored_orders, self.stored_inventory)

    @cached_property
    def kpis(self) -> DataFrame:
        return menu.kpis_of_gold(self.stored_gold, self.shares)

    @cached_property
    def profiles(self) -> DataFrame:
        return customers.customer_profiles(self.stored_masked, self.stored_orders)

    def _landed(self, payload: str, schema: str) -> DataFrame:
        """The payload landed once as JSON files, packed, and read back with its schema."""
        key = (self.spark.sparkContext.applicationId, self.folder, payload)
        if key not in _STORED:
            path = scratch_path(self.spark, payload)
            if payload == "order_payload":
                self.land_orders(path)
            else:
                getattr(self, payload).write.option("compression", "gzip").json(path)
            remove_at_exit(self.spark, path)
            _STORED[key] = path
        return read_payload(self.spark, _STORED[key], schema)

    def land_orders(self, path: str, *left_out: str) -> None:
        """The order payload as packed JSON files without some columns: one share of the orders after another, whose shuffles go before the next."""
        for share in range(self.shares):
            documents = sample.order_payload(self.spark, self.folder, share, self.shares).drop(*left_out)
            with shuffles_dropped(self.spark):
                documents.write.mode("append").option("compression", "gzip").json(path)

    order_documents = cached_property(lambda self: self._landed("order_payload", f"location_id string, {ORDER_PAYLOAD}"))
    media_documents = cached_property(lambda self: self._landed("media_payload", MEDIA_PAYLOAD))
    menu_documents = cached_property(lambda self: self._landed("menu_payload", MENU_PAYLOAD))
    profile_documents = cached_property(lambda self: self._landed("profile_payload", PROFILE_PAYLOAD))

    @cached_property
    def addresses(self) -> DataFrame:
        """An address for the regions whose site has no demo name and an even key."""
        return (
            self.table("region")
            .filter(F.col("r_name") == "AFRICA")
            .select(
                F.concat(F.lit("site_"), F.col("r_regionkey").cast("string")).alias("location_id"),
                F.concat(F.lit("1 Main Street, Ste 1, "), F.initcap("r_name"), F.lit(", CA")).alias("address"),
            )
        )
