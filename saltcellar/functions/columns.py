"""Column helpers: dates, clocks, money and ratios."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_FORMAT = "yyyyMMdd"

# Shapes of days and times in the sources. A text is parsed only when it has
# the shape, so unreadable texts cost a match and no exception.
DAY_SHAPE = r"^\d{8}$"
ZULU_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
US_CLOCK_SHAPE = r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2} [AaPp][Mm]$"
US_CLOCK_FORMAT = "M/d/yy h:mm a X"
OFFSET_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
LAST_YEAR_OF_TWO_DIGITS = 2068


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where a zero denominator gives NULL."""
    return F.try_divide(numerator, denominator)


def cents(amount: Column) -> Column:
    """Sum of money settled to cents, so that the order of addition leaves no trace."""
    return F.round(F.sum(amount), 2)


def mean_cents(amount: Column) -> Column:
    """Mean of money taken from the settled sum."""
    return F.try_divide(cents(amount), F.count(amount))


def parse_day(text: Column) -> Column:
    """YYYYMMDD text to a date, NULL when it is none."""
    dashed = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(text.rlike(DAY_SHAPE), dashed.try_cast("date"))


def day_text(day: Column) -> Column:
    return F.date_format(day, DAY_FORMAT)


def day_literal(value: str | dt.date | None) -> Column | None:
    if value is None:
        return None
    if isinstance(value, str):
        value = dt.datetime.strptime(value, "%Y%m%d").date()
    return F.lit(value)


def parse_clock(text: Column) -> Column:
    """Order and payment times: ISO with a Z, or US short form; other texts give NULL.

    Two-digit years above 68 belong to the twentieth century.
    """
    iso = _shaped_time(text, ZULU_SHAPE)
    short = F.when(
        text.rlike(US_CLOCK_SHAPE), F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(US_CLOCK_FORMAT))
    )
    short = F.when(
        F.year(short) > LAST_YEAR_OF_TWO_DIGITS, short - F.make_ym_interval(F.lit(100))
    ).otherwise(short)
    return F.coalesce(iso, short)


def _shaped_time(text: Column, shape: str) -> Column:
    return F.when(text.rlike(shape), text.try_cast("timestamp"))


def parse_offset_time(text: Column) -> Column:
    """Snapshot times with `Z`, `+hhmm` or `+hh:mm`, with or without a fraction."""
    return _shaped_time(text, OFFSET_SHAPE)


def parse_iso_time(text: Column) -> Column:
    """Any ISO time text; a text without an offset is read as UTC."""
    return _shaped_time(F.trim(text), ISO_SHAPE)


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssxxx")


def clean_text(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when `text` holds one of `words`; NULL counts as no."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return F.coalesce(found, F.lit(False))


def in_scope(
    df: DataFrame,
    location_ids: Sequence[str] | None = None,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    day_column: str = "business_date",
) -> DataFrame:
    """Rows of the given locations between two inclusive days; None leaves a side open.

    On a date column the bounds are date literals, on a text column YYYYMMDD texts, so
    both reach the scan as plain comparisons.
    """
    def bound(value):
        if dict(df.dtypes)[day_column] != "string":
            return day_literal(value)
        return F.lit(value if isinstance(value, str) else value.strftime("%Y%m%d"))

    if location_ids is not None:
        df = df.filter(F.col("location_id").isin(list(location_ids)))
    if start is not None:
        df = df.filter(F.col(day_column) >= bound(start))
    if end is not None:
        df = df.filter(F.col(day_column) <= bound(end))
    return df


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Spark limits each key per task before the shuffle
    (WindowGroupLimit), so a key with very many copies sends one row per task."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def portable(df: DataFrame) -> DataFrame:
    """Dates and times as text, for results that leave Spark."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)
