"""Small-group suppression and guards on what a result may hold."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The smallest group shown, which columns count, what must not be shown.
MIN_GROUP = 5
COUNT_COLUMN = re.compile(r"\b(count|orders?)\b|^n$|_n$")
RAW_IDENTIFIERS = ("order_guid", "order_id", "review_id", "customer_id")
RAW_CONTACTS = ("customer_email", "customer_phone", "first_name", "last_name", "email", "phone")
RAW_CONTACT_TABLES = ("customer_orders", "customer_orders_clean")


class PrivacyError(ValueError):
    """A result or a request that would show raw personal data."""


def count_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name is a count word; `order_count` is one word and is none."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and COUNT_COLUMN.search(f.name.lower())
    ]


def _large_enough(df: DataFrame, threshold: int) -> Column:
    kept = F.lit(True)
    for name in count_columns(df):
        kept = kept & F.coalesce(F.col(f"`{name}`") >= threshold, F.lit(False))
    return kept


def suppress_small(df: DataFrame, threshold: int = MIN_GROUP, seen: Observation | None = None) -> DataFrame:
    """Rows whose counts all reach the threshold; `seen` gets `suppressed` when the result runs."""
    kept = _large_enough(df, threshold)
    if seen is not None:
        df = df.observe(seen, F.count_if(~kept).alias("suppressed"))
    return df.filter(kept)


def suppressed_rows(df: DataFrame, threshold: int = MIN_GROUP) -> DataFrame:
    return df.agg(F.count_if(~_large_enough(df, threshold)).alias("suppressed"))


def min_group(df: DataFrame, keys: Sequence[Column], *measures: Column, threshold: int = MIN_GROUP) -> DataFrame:
    """Grouped measures, for groups of at least `threshold` rows."""
    grouped = df.groupBy(*keys).agg(*measures, F.count(F.lit(1)).alias("_rows"))
    return grouped.filter(F.col("_rows") >= threshold).drop("_rows")


def guard_output(df: DataFrame, denied: Iterable[str] = RAW_IDENTIFIERS + RAW_CONTACTS) -> DataFrame:
    """The same frame, or an error when a column shows raw identifiers or contacts."""
    shown = {name.lower() for name in df.columns} & {name.lower() for name in denied}
    if shown:
        raise PrivacyError(f"raw columns in a result: {', '.join(sorted(shown))}; aggregate or mask them")
    return df


class _Permitted(Mapping):
    """A view of the tables; each one is looked up when it is asked for."""

    def __init__(self, tables: Mapping[str, DataFrame], allowed: Iterable[str]):
        self._tables = tables
        self._names = [n for n in tables if n in set(allowed) - set(RAW_CONTACT_TABLES)]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise PrivacyError(f"table {name} is not permitted here; permitted: {', '.join(sorted(self._names))}")
        return self._tables[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def permitted(tables: Mapping[str, DataFrame], allowed: Iterable[str]) -> Mapping[str, DataFrame]:
    """The permitted tables only; asking for another one is an error."""
    return _Permitted(tables, allowed)
