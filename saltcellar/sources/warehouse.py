"""Tables whose loads are committed together, laid out by month or day, and compacted."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from saltcellar import schemas
from saltcellar.session import path_exists, prepare
from saltcellar.sources.files import LOAD, MONTH, PERIOD
from saltcellar.sources.sinks import add_missing_columns, with_period, write_table

DAY = "business_date"
COMMIT_SCHEMA = "name string, added array<struct<table:string, folder:string, rows:bigint>>, removed array<struct<table:string, folder:string>>"


@dataclass(frozen=True)
class Part:
    """A written folder of one table that no reader sees before it is committed."""

    table: str
    folder: str
    rows: int


class Warehouse:
    """Declared tables under `root`, read by the list of committed loads.

    A load writes folders <table>/load=<name>~<id>/period=<month or day>/ and then one commit record that names them all; rows and
    their log row appear with that record. Folders without a record (a load under way, or broken off) are not read. A load that is given
    again under its name takes the place of the earlier one. Records only add and remove folders that are written once, so their
    order does not matter. Tables without a business date have no such folders. `further` declares tables of the user's own: name ->
    (schema, columns of their folders).
    """

    def __init__(self, spark: SparkSession, root: str, grain: str = MONTH,
                 further: Mapping[str, tuple[StructType, tuple[str, ...]]] | None = None):
        self.spark, self.root, self.grain = prepare(spark), root.rstrip("/"), grain
        self.tables = {name: (schema, None) for name, schema in schemas.TABLES.items()} | dict(further or {})

    def stage(self, df: DataFrame, table: str, name: str) -> Part:
        """Write rows of a load; missing declared columns are added."""
        schema, parted = self.tables[table]
        rows = (add_missing_columns(df, table) if table in schemas.TABLES else df).select(*schema.names)
        folder = f"{name}~{uuid.uuid4().hex}"
        if parted is None:
            parted = (PERIOD,) if DAY in schema.names else ()
            rows = with_period(rows, self.grain) if parted else rows
        return Part(table, folder, write_table(rows, f"{self.root}/{table}/{LOAD}={folder}", "overwrite", parted))

    def commit(self, name: str, added: Iterable[Part], removed: Iterable[tuple[str, str]] = ()) -> None:
        """One record in one file: Spark moves it into place when it is whole."""
        record = (name, [(p.table, p.folder, p.rows) for p in added], list(removed))
        self.spark.createDataFrame([record], COMMIT_SCHEMA).coalesce(1).write.mode("append").json(f"{self.root}/commits")

    def load(self, rows: Mapping[str, DataFrame], name: str) -> dict[str, int]:
        """Append to several tables in one commit; returns the rows written. Repeating a name replaces its earlier load."""
        earlier = self.earlier(name)
        parts = [self.stage(df, table, name) for table, df in rows.items()]
        self.commit(name, parts, earlier)
        return {p.table: p.rows for p in parts}

    def earlier(self, name: str) -> list[tuple[str, str]]:
        """(table, folder) of what is committed under a load's name."""
        return [(r["table"], r["folder"]) for r in self.folders().filter(F.col("folder").startswith(f"{name}~")).collect()]

    def records(self) -> DataFrame:
        path = f"{self.root}/commits"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).json(path)

    def folders(self) -> DataFrame:
        """(table, folder, rows) of the committed loads: a few rows a load, fewer after a compaction."""
        added = self.records().select(F.explode("added").alias("p")).select("p.*")
        removed = self.records().select(F.explode("removed").alias("p")).select("p.*")
        return added.join(removed, ["table", "folder"], "left_anti")

    def read(self, table: str, where: Column | None = None) -> DataFrame:
        """The committed rows, with the declared columns and types. `where` may name the folder column `period`."""
        return self.read_folders(table, [r["folder"] for r in self.folders().filter(F.col("table") == table).collect()], where)

    def read_folders(self, table: str, names: Sequence[str], where: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of folders, committed or staged. `columns`: which ones, `period` among them if asked for; the declared ones if None."""
        (schema, _), base = self.tables[table], f"{self.root}/{table}"
        if not names:
            return self.spark.createDataFrame([], schema)
        given = schema if DAY not in schema.names else StructType([*schema.fields, StructField(PERIOD, StringType())])
        rows = self.spark.read.schema(given).option("basePath", base).parquet(*[f"{base}/{LOAD}={name}" for name in sorted(names)])
        return (rows if where is None else rows.filter(where)).select(*(columns or schema.names))

    def compact(self, table: str, below_rows: int = 1_000_000) -> int:
        """Put the loads of fewer than `below_rows` rows into one; returns how many. The rows of the table stay as they are.

        Their names are free afterwards: a load given again under one of them is added.
        """
        small = [r["folder"] for r in self.folders().filter((F.col("table") == table) & (F.col("rows") < below_rows)).collect()]
        if len(small) < 2:
            return 0
        self.commit("compaction", [self.stage(self.read_folders(table, small), table, "compacted")], [(table, n) for n in small])
        return len(small)

    def unread(self, table: str) -> list[str]:
        """Folders of a table that no commit holds, to be removed once no load and no reader can be under way in them."""
        if not path_exists(self.spark, f"{self.root}/{table}"):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        listed = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        found = [f.getPath().getName().removeprefix(f"{LOAD}=") for f in listed]
        live = {r["folder"] for r in self.folders().filter(F.col("table") == table).collect()}
        return sorted(set(found) - live)
