"""Readers: stored tables, CSV export folders and JSON payloads."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.session import prepare, settle

# The mark in a file name that tells what the export holds.
EXPORT_MARKS = {
    "orders": ("OrderDetails", "CheckDetails"),
    "payments": ("PaymentDetails",),
    "order_items": ("ItemSelectionDetails",),
    "time_entries": ("TimeEntries",),
    "inventory": ("AllItemsReport",),
}
# location / day / file at the end of the path; the file may be a folder that Spark wrote
BYTE_ORDER_MARK = "\ufeff"
PATH_PARTS = r"/([^/]+)/([^/]+)/([^/]+?)(?:/part-[^/]+)?$"


HEADERS_AT_ONCE = 16_000_000  # characters of headers and paths up to which every task gets all headers
LOAD = "load"  # the folder name of an append to a declared table
PERIOD = "period"  # the folder name of a month or day inside
DAY_GRAIN, MONTH = "yyyyMMdd", "yyyyMM"


def in_period(start: str | None, end: str | None) -> Column:
    """The folders, of months or days, that can hold days from `start` to `end` (YYYYMMDD)."""
    name = F.col(PERIOD)
    after = name >= F.substring(F.lit(start), 1, F.length(name)) if start else F.lit(True)
    before = name <= F.substring(F.lit(end), 1, F.length(name)) if end else F.lit(True)
    return after & before


def read_table(spark: SparkSession, path: str, table: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A parquet table; when declared, its columns must be there with the declared types.

    With `start` or `end` (YYYYMMDD) only rows of these business days, from the folders of their periods. Folder names are texts,
    as `prepare` sets it.
    """
    df = prepare(spark).read.parquet(path)
    if start or end:
        df = df.filter(in_period(start, end)) if PERIOD in df.columns else df
        df = df.filter(F.col("business_date").between(start or "", end or "99999999"))
    df = df.drop(LOAD, PERIOD)
    if table is None:
        return df
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [
        f"{f.name} {f.dataType.simpleString()}, found {have.get(f.name)}"
        for f in schemas.TABLES[table].fields
        if have.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError(f"{table} at {path}: " + "; ".join(wrong))
    return df


def read_tables(spark: SparkSession, folder: str, tables: Iterable[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{folder}/{name}.parquet", name) for name in tables}


def read_export(spark: SparkSession, root: str, mark: str) -> DataFrame | None:
    """The CSV files under root/<location>/<day>/ whose name holds `mark`, all columns as text, by name.

    Files of one kind may have further columns, lack some or order them otherwise.
    """
    return read_by_name(export_lines(spark.read, root, mark))


def export_lines(reader, root: str, mark: str) -> DataFrame:
    """The lines of the exports of one kind, with the path of their file and where their split of it begins."""
    lines = reader.format("text").option("recursiveFileLookup", True).load(f"{root}/*/*/*{mark}*.csv")
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def headers(lines: DataFrame) -> DataFrame:
    """(file, header): the first filled line of each file. Only the first split of a file is looked at, and each task sends one
    line a file."""
    placed = lines.filter("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id()).filter("split = 0")
    first = placed.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return first.filter(F.col("header") != BYTE_ORDER_MARK)


def _with_cells(lines: DataFrame, line: str, width: int, name: str) -> DataFrame:
    """The cells of a line by position, as an array of `width` texts; missing ones are NULL."""
    row = F.from_csv(F.col(line), ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'})
    # Exploded from an array of one, so that a line is cut once and not again for each column taken from it.
    cut = lines.withColumn("_row", F.explode(F.array(row)))
    return cut.withColumn(name, F.array(*[F.col(f"_row.c{i}") for i in range(width)])).drop("_row")


def read_by_name(lines: DataFrame, declared: Iterable[str] = ()) -> DataFrame | None:
    """Lines of CSV files with their cells matched to columns by name, next to location_id, business_date and file_name from the path.

    Each line meets the header of its own file: a table of one row a file. Where it is small, by its measured size, every task gets it
    and lines stay where they are read, so a few large files are not each gathered in one task; else lines and headers are joined by
    file. The driver itself looks at the different column names and the greatest number of columns. A file may be read in many splits. Declared columns that no file has are empty; of
    columns with one name in a file the first counts; lines equal to the header are left out. None without files.
    """
    found = settle(headers(lines).withColumn("plain", F.replace("header", F.lit(BYTE_ORDER_MARK), F.lit(""))))
    commas = F.length("plain") - F.length(F.replace("plain", F.lit(","), F.lit("")))
    width, chars = found.agg(F.max(commas + 1), F.sum(F.length("file") + F.length("header"))).first()
    if width is None:
        return None
    named = settle(_with_cells(found, "plain", width, "names").select(F.col("file").alias("of"), "header", "names"))
    columns = [r["name"] for r in named.select(F.explode("names").alias("name")).distinct().collect() if r["name"] is not None]
    # Places and the parts of the path are looked up once a file, not in every line.
    placed, path = {name: f"_at_{i}" for i, name in enumerate(sorted(columns))}, F.col("of")
    places = named.select(
        "of", "header", *[F.array_position("names", F.lit(name)).cast("int").alias(at) for name, at in placed.items()],
        F.url_decode(F.regexp_extract(path, PATH_PARTS, 1)).alias("_location"),
        F.regexp_extract(path, PATH_PARTS, 2).alias("_day"),
        F.url_decode(F.regexp_extract(path, PATH_PARTS, 3)).alias("_name"),
    )
    places = settle(places)
    places = F.broadcast(places) if chars <= HEADERS_AT_ONCE else places
    rows = lines.filter("trim(value) <> ''").join(places, F.col("file") == F.col("of")).filter(F.col("value") != F.col("header"))
    cut = _with_cells(rows, "value", width, "cells")
    cells = [F.when(F.col(at) > 0, F.get("cells", F.col(at) - 1)).alias(name) for name, at in placed.items()]
    absent = [F.lit(None).cast("string").alias(name) for name in declared if name not in placed]
    parts = [F.col(f).alias(name) for f, name in (("_location", "location_id"), ("_day", "business_date"), ("_name", "file_name"))]
    return cut.select(*cells, *absent, *parts)


def read_exports(spark: SparkSession, root: str, table: str) -> list[DataFrame]:
    """One frame per kind of file that feeds `table`; kinds without files are left out."""
    frames = []
    for mark in EXPORT_MARKS[table]:
        try:
            frame = read_export(spark, root, mark)
            frames += [frame] if frame is not None else []
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return frames


def import_exports(spark: SparkSession, root: str, table: str, importer) -> DataFrame | None:
    """All export files of `table` mapped by `importer` and put together."""
    parts = [importer(df) for df in read_exports(spark, root, table)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_payload(spark: SparkSession, path: str, schema: str, one_per_line: bool = True) -> DataFrame:
    """JSON payloads with a declared schema; `one_per_line=False` reads arrays in whole files."""
    return spark.read.schema(schema).option("multiLine", not one_per_line).json(path)


def parse_payload(texts: DataFrame, column: str, schema: str, keep: Iterable[str] = ()) -> DataFrame:
    """JSON texts in a column to payload columns, next to the columns in `keep`."""
    return texts.select(*keep, F.from_json(F.col(column), schema).alias("_payload")).select(*keep, "_payload.*")
