"""Distinct counts that add up: exact bitmaps by day, merged for any window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.functions.columns import in_scope
from saltcellar.session import settle

GRAIN = ("location_id", "business_date")


def number_keys(rows: DataFrame, key: str, first_day: str = "business_date") -> DataFrame:
    """(key, number): a number of its own for each key, stored once.

    Keys are numbered in the order of their first day, part by part, so the keys of a day have neighbouring numbers and fall into few
    bitmaps. Numbers have gaps between parts, which cost nothing. NULL is no key.
    """
    firsts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(first_day).alias("_first"))
    placed = firsts.repartitionByRange("_first", key).sortWithinPartitions("_first", key)
    return settle(placed.select(key, (F.monotonically_increasing_id() + 1).alias("number")))


def day_bitmaps(rows: DataFrame, keys: Mapping[str, DataFrame], grain: Sequence[str] = GRAIN) -> DataFrame:
    """(grain, measure, bucket, bits): which numbers of each measure a location had on a day, 32,768 to a bitmap of 4 KB.

    `keys` gives the numbered keys of each measure; its first column is the column of `rows` that is counted. Tasks combine bitmaps before
    the shuffle.
    """
    parts = None
    for measure, numbered in keys.items():
        key = numbered.columns[0]
        found = rows.select(*grain, key).join(numbered, key)
        bits = found.groupBy(*grain, F.bitmap_bucket_number("number").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
        )
        bits = bits.select(*grain, F.lit(measure).alias("measure"), "bucket", "bits")
        parts = bits if parts is None else parts.unionByName(bits)
    return parts


def merged_counts(days: DataFrame, location_ids=None, start=None, end=None, by: Sequence[str] = ()) -> DataFrame:
    """(by, measure, distinct): exact distinct counts of a scope from the day table alone, whatever was counted twice on several days.

    Days of a bucket are merged by OR where they lie; what is shuffled is one bitmap a bucket and task.
    """
    inside = in_scope(days, location_ids, start, end)
    merged = inside.groupBy(*by, "measure", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by, "measure").agg(F.sum(F.bitmap_count("bits")).alias("distinct"))
