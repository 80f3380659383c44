"""What the operators of this subpackage share: tables, stored intermediates, word forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from saltcellar.session import remove_at_exit, scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once under the shared scratch folder and read again: a lineage cut with column pruning.

    The table goes when the driver ends."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_and_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """`stored`, with aggregates of the rows taken by the write itself, so that no query of their own is run for them."""
    seen = Observation()
    rows = stored(df.observe(seen, *[column.alias(name) for name, column in counts.items()]), label)
    return rows, seen.get


def text_of(column: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def whole_row(df: DataFrame, name: str = "own") -> Column:
    """All columns in one, so that no name of theirs clashes with a name of the operator's; `name.*` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def key_hash(column: Column) -> Column:
    """60 bits of the MD5 of a key written as text (null as empty): any SQL engine can compute it."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once: an expression named inside a lambda would be computed at every step."""
    return F.transform(F.array(value), use)[0]


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """`df`, whose whole texts go to Python workers: its session sends at most so many rows at once from now on."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(setting)) <= rows:
        conf.set(setting, str(rows))
    return df


def sent_if_small(df: DataFrame, most_rows: int = 400_000) -> DataFrame:
    """A stored table of narrow rows marked for broadcast if it is counted to have at most `most_rows`.

    Used where the other side of a join carries whole texts: below the bound they stay where they are read, beyond it both
    sides are shuffled. The result is the same.
    """
    return F.broadcast(df) if df.count() <= most_rows else df
