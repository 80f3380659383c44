"""Clean views kept up by the days or months that a load touches."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltcellar.operators import views
from saltcellar.session import path_exists, remove_at_exit, scratch_path
from saltcellar.sources.files import DAY_GRAIN, PERIOD
from saltcellar.sources.sinks import with_period
from saltcellar.sources.warehouse import DAY, Warehouse

BUCKETS = 256  # folders of an order index
INDEX = T.StructType([T.StructField(name, T.StringType()) for name in ("unit", PERIOD, "bucket")])
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # the folder name that Spark gives to NULL


@dataclass(frozen=True)
class KeptView:
    """A view that removes copies within an order. The copies of an order may lie in several days of the raw table."""

    raw: str
    build: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class DayView:
    """A view whose rows of a day are made from that day of its source alone: a kept view or a raw table."""

    source: str
    build: Callable[[DataFrame], DataFrame]


def standard_views(name_map: DataFrame) -> dict[str, KeptView | DayView]:
    """Orders, order lines, daily sales and item sales. A changed name map touches every day: rebuild then."""
    return {
        "orders_clean": KeptView("orders", views.orders_clean),
        "order_items_clean": KeptView("order_items", lambda rows: views.order_items_clean(rows, name_map)),
        "daily_sales": DayView("orders_clean", views.daily_sales),
        "item_performance": DayView("order_items", lambda rows: views.item_performance(rows, name_map)),
    }


def _unit() -> Column:
    return F.coalesce(F.col("order_guid"), F.lit(""))


def _inside(periods: list[str | None]) -> Column:
    """Rows of these folders, of a raw table or a view; NULL is the folder of days that are none."""
    named = F.col(PERIOD).isin([p for p in periods if p is not None])
    return named | F.col(PERIOD).isNull() if None in periods else named


class ViewStore:
    """Committed raw loads, an index of their orders, and views by period (day or month), under one folder.

    `load` commits raw rows together with (order, period) index rows in folders by hash of the order, so the periods of a load's
    orders are found in their buckets. `refresh` makes the touched periods of the views again: those of all copies of the changed
    orders, now and before. Rows of other orders stay as they are; changed orders are built from all their copies, which all lie in
    touched periods. So a refresh reads and writes touched periods only, whatever the age of the table. Periods are bounded by the
    calendar and are listed in the plan.
    """

    def __init__(self, spark: SparkSession, root: str, kept: Mapping[str, KeptView | DayView], grain: str = DAY_GRAIN, buckets: int = BUCKETS):
        self.kept, self.buckets = dict(kept), buckets
        raw = {v.raw for v in self.kept.values() if isinstance(v, KeptView)}
        self.house = Warehouse(spark, root, grain, {f"{name}_periods": (INDEX, ("bucket",)) for name in raw})
        self.spark, self.grain = self.house.spark, grain

    def _stored(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        remove_at_exit(self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def load(self, rows: DataFrame, raw: str, name: str) -> DataFrame:
        """Commit rows under a load's name, in the place of its earlier ones. Returns the changed orders: (unit, period, bucket) of
        the load and of what it replaces, stored.

        Rows are written once, the orders among them are listed once, from the staged folder."""
        index = f"{raw}_periods"
        earlier = self.house.earlier(name)
        rows = self.house.stage(rows, raw, name)
        bucket = F.pmod(F.xxhash64("unit"), F.lit(self.buckets)).cast("string")
        staged = self.house.read_folders(raw, [rows.folder], columns=("order_guid", PERIOD))
        listed = self._stored(staged.select(_unit().alias("unit"), PERIOD).distinct().withColumn("bucket", bucket), f"changed-{raw}")
        replaced, changed = [folder for table, folder in earlier if table == index], listed
        if replaced:
            changed = self._stored(listed.union(self.house.read_folders(index, replaced)).distinct(), f"changed-{raw}")
        self.house.commit(name, [rows, self.house.stage(listed, index, name)], earlier)
        return changed

    def touched(self, raw: str, changed: DataFrame) -> list[str | None]:
        """Periods that hold copies of the changed orders, or held them before the load. Reads their index buckets only, and joins
        only rows of periods that the changed orders do not name themselves."""
        buckets = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # at most `self.buckets`
        named = [r[PERIOD] for r in changed.select(PERIOD).distinct().collect()]
        other = self.house.read(f"{raw}_periods", F.col("bucket").isin(buckets)).filter(~F.coalesce(_inside(named), F.lit(False)))
        if not other.isEmpty():
            found = other.join(changed.select("unit", "bucket"), ["unit", "bucket"], "left_semi").select(PERIOD).distinct()
            named += [r[PERIOD] for r in found.collect()]
        return sorted(named, key=str)

    def refresh(self, raw: str, changed: DataFrame) -> list[str | None]:
        """Make the touched periods of all views over a raw table again; returns them."""
        periods = self.touched(raw, changed)
        units = changed.select("unit")
        blank = not units.filter(F.col("unit") == "").isEmpty()
        done: set[str] = set()
        for name, view in self.kept.items():
            if isinstance(view, KeptView) and view.raw == raw:
                self._write(name, self.rebuilt(name, units, periods, blank), periods)
                done.add(name)
        for name, view in self.kept.items():
            if isinstance(view, DayView) and (view.source == raw or view.source in done):
                self._write(name, self.remade(name, periods), periods)
        return periods

    def rebuilt(self, name: str, units: DataFrame, periods: list[str | None], blank: bool = True) -> DataFrame:
        """The touched periods of a kept view: changed orders built again, the rows of all others as they are.

        Unless rows without an order are among the changed ones (`blank`), rows meet them by order_guid itself, by which a view
        removes copies, so they are not shuffled again for that.
        """
        view, unit = self.kept[name], _unit() if blank else F.col("order_guid")
        raw = self.house.read(view.raw, _inside(periods))
        fresh = with_period(view.build(raw.join(units, unit == F.col("unit"), "left_semi")), self.grain)
        old = self._read(name)
        if old is None:
            return fresh
        return old.filter(_inside(periods)).join(units, unit == F.col("unit"), "left_anti").unionByName(fresh)

    def remade(self, name: str, periods: list[str | None]) -> DataFrame:
        view = self.kept[name]
        if view.source in self.kept:
            rows = self._read(view.source)
            rows = self.view(view.source) if rows is None else rows.filter(_inside(periods)).drop(PERIOD)
        else:
            rows = self.house.read(view.source, _inside(periods))
        return with_period(view.build(rows), self.grain)

    def view(self, name: str) -> DataFrame:
        """A view as it stands; empty before its first refresh."""
        rows = self._read(name)
        return self.spark.createDataFrame([], self._schema(name)).drop(PERIOD) if rows is None else rows.drop(PERIOD)

    def _schema(self, name: str) -> T.StructType:
        view = self.kept[name]
        source = view.raw if isinstance(view, KeptView) else view.source
        empty = self.spark.createDataFrame([], self._schema(source) if source in self.kept else self.house.tables[source][0])
        return with_period(view.build(empty.drop(PERIOD)), self.grain).schema

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.house.root}/{name}"
        return self.spark.read.schema(self._schema(name)).parquet(path) if path_exists(self.spark, path) else None

    def _write(self, name: str, rows: DataFrame, periods: list[str | None]) -> None:
        """Replace the folders of these periods; those without rows go.

        The rows may be read from the folders that are replaced: Spark writes beside them and puts the new ones in place at the end.
        A folder that still has its files afterwards got no rows.
        """
        path = f"{self.house.root}/{name}"
        old = self._read(name)
        before = set() if old is None else set(old.inputFiles())
        writer = rows.hint("rebalance", PERIOD).sortWithinPartitions(PERIOD, "location_id", DAY).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)
        still = {file.rsplit("/", 2)[1] for file in before & set(self._read(name).inputFiles())} if before else set()
        for period in periods:
            if (place := f"{PERIOD}={NO_DAY if period is None else period}") in still:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{place}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
