"""Writers: tables, exports, logs, manifests and schema upkeep."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.functions.columns import parse_day
from saltcellar.sources.files import LOAD, MONTH, PERIOD


def with_period(df: DataFrame, grain: str = MONTH) -> DataFrame:
    """The folder column: month or day of the business date (a date, or text), NULL where it is no day."""
    day = F.col("business_date")
    return df.withColumn(PERIOD, F.date_format(day if dict(df.dtypes)["business_date"] == "date" else parse_day(day), grain))


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "append",
    partition_by: tuple[str, ...] | None = None,
    order_by: tuple[str, ...] = ("location_id", "business_date"),
    grain: str = MONTH,
    compression: str = "snappy",
) -> int:
    """Parquet (snappy, if nothing else is asked for) under one folder per location and per month (`grain`: or day) of the business date, where there are such
    columns, sorted inside by day: filters on both open few folders and row groups.

    Rows of a folder are brought together first, so it gets few files; Spark splits a folder that is too large for one task
    (rebalance). Other folders may be asked for. Returns the rows written, counted by the write itself.
    """
    if partition_by is None:
        partition_by = tuple(c for c in ("location_id",) if c in df.columns)
        if "business_date" in df.columns:
            partition_by, df = (*partition_by, PERIOD), with_period(df, grain)
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    sort = [c for c in dict.fromkeys((*partition_by, *order_by)) if c in df.columns]
    if sort:
        rows = rows.sortWithinPartitions(*sort)
    # Counted by the tasks that write: a map task that is run again after a lost executor counts nothing twice.
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return seen.get["rows"]


def write_csv(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ("location_id",)) -> int:
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode(mode).option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return seen.get["rows"]


def append_rows(df: DataFrame, path: str, table: str, load: str | None = None) -> int:
    """Append to a declared table; missing columns are added, required ones must be set.

    Every append is a folder load=<name> of its own, with a folder per month inside where the table has days. A named load that is written again replaces itself, so a repeated
    batch of a stream adds nothing twice; `read_table` gives the declared columns of all loads.
    """
    rows = add_missing_columns(df, table).select(*schemas.TABLES[table].fieldNames())
    target = f"{path}/{LOAD}={load or uuid.uuid4().hex}"
    if "business_date" not in rows.columns:
        return write_table(rows, target, "overwrite", partition_by=())
    return write_table(with_period(rows), target, "overwrite", partition_by=(PERIOD,))


def replace_table(df: DataFrame, path: str) -> int:
    """Truncate and load."""
    return write_table(df, path, "overwrite", partition_by=())


# The tables an analysis export holds.
EXPORT_TABLES = (
    "orders_clean", "order_items_clean", "payments_clean", "daily_sales", "item_performance",
    "menu_canonical_map", "inventory", "customer_orders_masked",
)


def export_tables(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write the eight analysis tables and return their row counts, one row per table."""
    if absent := [name for name in EXPORT_TABLES if name not in tables]:
        raise ValueError(f"an analysis export holds {', '.join(absent)} as well")
    counts = [
        (name, write_table(tables[name], f"{folder}/{name}.parquet", "overwrite", partition_by=())) for name in EXPORT_TABLES
    ]
    return spark.createDataFrame(counts, "table_name string, row_count bigint")


def add_missing_columns(df: DataFrame, table: str) -> DataFrame:
    """Declared columns that are absent, as typed NULLs."""
    have = {name.lower() for name in df.columns}
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in schemas.TABLES[table].fields if f.name.lower() not in have
    }
    return df.withColumns(missing) if missing else df


def missing_required(df: DataFrame, table: str) -> DataFrame:
    """Rows without a value, per required column."""
    names = schemas.required(table)
    counted = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("missing_rows")) for n in names])
    return counted.select(F.explode(rows).alias("row")).select(F.lit(table).alias("table_name"), "row.*")


def log_entries(counts: DataFrame) -> DataFrame:
    """Log rows for location_id, business_date, file_type, file_name and rows_imported."""
    return counts.select(
        F.uuid().alias("import_id"),
        "location_id",
        "business_date",
        "file_type",
        "file_name",
        "rows_imported",
        F.current_timestamp().alias("import_timestamp"),
    )


def log_import(counts: DataFrame, path: str, load: str | None = None) -> int:
    return append_rows(log_entries(counts), path, "import_log", load)


def table_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, in one frame."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def write_manifest(spark: SparkSession, paths: Mapping[str, str], target: str, **facts: str) -> DataFrame:
    """Rows and bytes of written tables, with the facts of the pull; also stored as JSON.

    The bytes come from the file metadata of the rows read, one figure per file.
    """
    parts = []
    for name, path in paths.items():
        files = spark.read.parquet(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
        )
        per_file = files.groupBy("file", "size").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
            .select(F.lit(name).alias("table_name"), "row_count", "bytes")
        )
    manifest = reduce(DataFrame.unionByName, parts).withColumns({k: F.lit(v) for k, v in facts.items()})
    manifest.write.mode("overwrite").json(target)
    return spark.read.schema(manifest.schema).json(target)
