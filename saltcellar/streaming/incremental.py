"""File streams into tables, and the dates still to be fetched.

Every stream runs with `availableNow`: it takes what has arrived since the last run and
stops. The checkpoint keeps the files seen, and a batch is a load of its own in the table,
so a run that is repeated or restarted adds nothing twice and other appends stand beside it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.functions.columns import DAY_FORMAT, day_text, parse_day
from saltcellar.sources.files import LOAD, export_lines, read_by_name
from saltcellar.sources.sinks import append_rows, log_entries, log_import

# What a text export has in its columns, by the mark in its file name.
EXPORT_HEADERS = {
    "OrderDetails": ("Order Id", "Opened", "Dining Options", "Total", "Amount", "Tax", "Tip", "Discount Amount"),
    "PaymentDetails": ("order_guid", "payment_method", "amount", "payment_date"),
    "ItemSelectionDetails": ("Order Id", "Menu Item", "Sales Category", "Qty", "Gross Price", "Net Price"),
    "AllItemsReport": ("Menu Item", "Menu Group", "Item Qty", "Avg Price"),
    "TimeEntries": (
        "Employee", "Job Title", "In Date", "Out Date", "Total Hours", "Payable Hours", "Regular Hours", "Overtime Hours",
        "Cash Tips Declared", "Non Cash Tips", "Total Gratuity", "Total Tips", "Wage",
    ),
}


def run_stream(rows: DataFrame, batch: Callable[[DataFrame, str], None], checkpoint: str) -> None:
    """Give what is new to `batch` with a name that a repeated run gives again, and stop."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.foreachBatch(lambda found, number: batch(found, f"stream-{number}"))
    writer.trigger(availableNow=True).start().awaitTermination()


def new_export_files(spark: SparkSession, root: str, mark: str) -> DataFrame:
    """A stream over the lines of the CSV exports of one kind under root/<location>/<day>/."""
    return export_lines(spark.readStream, root, mark)


def ingest_new_files(
    spark: SparkSession, root: str, mark: str, importer: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, table: str,
    log: str | None = None,
) -> None:
    """Import the export files that have arrived since the last run into a declared table, and log each file's rows.

    Columns are matched by name, per file: further ones are left, missing ones are empty. All declared columns of the table
    are written, with created_at as the time of the run.
    """

    def batch(found: DataFrame, load: str) -> None:
        export = read_by_name(found, EXPORT_HEADERS[mark])
        if export is None:
            return
        append_rows(_stamped(importer(export), table), target, table, f"{mark}-{load}")
        if log:
            counted = export.groupBy("location_id", "business_date", "file_name").agg(F.count(F.lit(1)).alias("rows_imported"))
            log_import(counted.withColumn("file_type", F.lit("CSV")), log, f"{mark}-{load}")

    run_stream(new_export_files(spark, root, mark), batch, checkpoint)


def _stamped(rows: DataFrame, table: str) -> DataFrame:
    has = "created_at" in schemas.TABLES[table].fieldNames()
    return rows.withColumn("created_at", F.current_timestamp()) if has else rows


def new_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def snapshot_append(
    spark: SparkSession,
    landing: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    table: str = "media_snapshots",
    log: str | None = None,
) -> None:
    """Append snapshot rows (of media or profiles) of the payload files that have arrived since the last run, with log rows."""

    def batch(found: DataFrame, load: str) -> None:
        append_rows(_stamped(transform(found), table), target, table, load)
        if log:
            written = found.sparkSession.read.parquet(f"{target}/{LOAD}={load}")
            counted = written.groupBy(F.col("account_id").alias("location_id"), "source_run_id").agg(
                F.count(F.lit(1)).alias("rows_imported"), F.date_format(F.current_timestamp(), "yyyyMMdd").alias("business_date")
            )
            log_import(counted.withColumns({"file_type": F.lit(table), "file_name": F.col("source_run_id")}), log, f"{table}-{load}")

    run_stream(new_payloads(spark, landing, schema), batch, checkpoint)


def unlogged_imports(imported: DataFrame, log: DataFrame, file_type: str) -> DataFrame:
    """Log rows for the location-days of a table that the log does not hold yet."""
    counted = imported.groupBy("location_id", "business_date").agg(F.count(F.lit(1)).alias("rows_imported"))
    logged = log.filter(F.col("file_type") == file_type).select("location_id", "business_date")
    fresh = counted.join(logged, ["location_id", "business_date"], "left_anti")
    return log_entries(fresh.withColumn("file_type", F.lit(file_type)).withColumn("file_name", F.lit(file_type)))


def latest_import_date(log: DataFrame, location_id: str | None = None, source: str | None = None) -> DataFrame:
    """The newest logged day per location, or of one location."""
    rows = _log_rows(log, location_id, source)
    return rows.groupBy("location_id").agg(F.max("business_date").alias("latest_date"))


def imported_dates(log: DataFrame, location_id: str | None = None, source: str | None = None) -> DataFrame:
    rows = _log_rows(log, location_id, source)
    return rows.select("location_id", "business_date").distinct().orderBy("location_id", "business_date")


def _log_rows(log: DataFrame, location_id: str | None, source: str | None) -> DataFrame:
    if location_id is not None:
        log = log.filter(F.col("location_id") == location_id)
    if source is not None:
        log = log.filter(F.col("file_type") == source)
    return log


def sync_range(
    sites: DataFrame,
    log: DataFrame,
    today: dt.date,
    interval_days: int = 30,
    source: str = "API",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """The days to fetch per site: after the newest logged one to yesterday, else the last days.

    A given start or end replaces the computed one; sites that are up to date have no row.
    """
    latest = latest_import_date(log, source=source)
    yesterday = (today - dt.timedelta(days=1)).strftime("%Y%m%d")
    after = day_text(F.date_add(parse_day(F.col("latest_date")), 1))
    first = F.coalesce(after, F.lit((today - dt.timedelta(days=interval_days)).strftime("%Y%m%d")))
    return (
        sites.select("location_id")
        .distinct()
        .join(latest, "location_id", "left")
        .select(
            "location_id",
            (F.lit(start) if start else first).alias("start_date"),
            F.lit(end or yesterday).alias("end_date"),
        )
        .filter(F.col("start_date") <= F.col("end_date"))
    )


def pending_dates(ranges: DataFrame, log: DataFrame, source: str | None = None) -> DataFrame:
    """Each day of the ranges that the log does not hold."""
    days = ranges.select(
        "location_id",
        F.explode(F.sequence(parse_day(F.col("start_date")), parse_day(F.col("end_date")))).alias("day"),
    ).select("location_id", F.date_format("day", DAY_FORMAT).alias("business_date"))
    return days.join(imported_dates(log, source=source), ["location_id", "business_date"], "left_anti")


def refresh_window(
    df: DataFrame, now: Column, start: Column | None = None, end: Column | None = None, refresh_days: int = 30
) -> DataFrame:
    """start_date and end_date (YYYY-MM-DD): the given ones, else the last days up to now in UTC."""
    today = F.date_format(now, "yyyy-MM-dd")
    back = F.date_format(F.date_sub(F.to_date(now), refresh_days), "yyyy-MM-dd")
    no_text = F.lit(None).cast("string")
    start = no_text if start is None else start
    end = no_text if end is None else end
    given = start.isNotNull() | end.isNotNull()
    last = F.coalesce(end, today)
    first = F.when(given, F.coalesce(start, last)).otherwise(back)
    wrong = F.raise_error(F.lit("start date must be on or before end date"))
    return df.withColumns({"start_date": F.when(first > last, wrong).otherwise(first), "end_date": last})


def backfill_chunks(df: DataFrame, today: Column, years: int, chunk: str = "year") -> DataFrame:
    """The complete calendar years before `today` cut into chunks, oldest first."""
    months = {"year": 12, "quarter": 3, "month": 1}[chunk]
    first = F.make_date(F.year(today) - years, F.lit(1), F.lit(1))
    last = F.make_date(F.year(today) - 1, F.lit(13 - months), F.lit(1))
    starts = F.sequence(first, last, F.make_ym_interval(F.lit(0), F.lit(months)))
    chunk_end = F.least(F.date_sub(F.add_months(F.col("_start"), months), 1), today)
    return (
        df.withColumn("_start", F.explode(starts))
        .filter(F.col("_start") <= today)
        .withColumns({"start_date": day_text(F.col("_start")), "end_date": day_text(chunk_end)})
        .drop("_start")
    )
