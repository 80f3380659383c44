"""Exact quantiles at any size, correlation, and tail probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.functions.columns import ratio

BUCKETS = 512


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles of `column`, NULLs left out; exact at any size, all in the same passes.

    Values are counted in equal-width buckets between the smallest and the largest; each bucket that holds a wanted rank
    is cut again between its own smallest and largest value, until that is one value. A pass is one map-side combined
    aggregate with a few hundred groups per wanted rank; two or three passes are usual, as `df` is read in each, it should
    be a stored or settled table.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    whole = values.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not whole["n"]:
        return [None for _ in probabilities]
    positions = [p * (whole["n"] - 1) for p in probabilities]
    ranks = {math.floor(x) for x in positions} | {math.ceil(x) for x in positions}
    # rank -> (smallest and largest value of its bucket, rows below the bucket)
    held = {rank: (whole["low"], whole["high"], 0) for rank in ranks}
    while wide := sorted({(low, high) for low, high, _ in held.values() if low < high}):
        counted = _counted(values, wide)
        for rank, (low, high, below) in held.items():
            for bucket in counted.get((low, high), []):
                if rank < below + bucket["n"]:
                    held[rank] = (bucket["low"], bucket["high"], below)
                    break
                below += bucket["n"]
    found = []
    for x in positions:
        lower, upper = held[math.floor(x)][0], held[math.ceil(x)][0]
        found.append(lower + (upper - lower) * (x - math.floor(x)))
    return found


def _counted(values: DataFrame, ranges: list[tuple[float, float]]) -> dict[tuple[float, float], list]:
    """Buckets of each range in order, with rows, smallest and largest value. Ranges do not overlap."""
    v = F.col("v")
    place = F.lit(None).cast("struct<part:int,bucket:int>")
    for i, (low, high) in enumerate(ranges):
        # Halves, so that the width of a range of huge values stays finite.
        share = (v / 2 - low / 2) / (high / 2 - low / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        place = F.when(v.between(low, high), F.struct(F.lit(i).alias("part"), bucket.alias("bucket"))).otherwise(place)
    rows = (
        values.select("v", place.alias("place"))
        .filter(F.col("place").isNotNull())
        .groupBy("place.part", "place.bucket")
        .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .collect()
    )
    out: dict[tuple[float, float], list] = {}
    for row in sorted(rows, key=lambda r: (r["part"], r["bucket"])):
        out.setdefault(ranges[row["part"]], []).append(row)
    return out


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side.

    The built-in `corr` raises on a constant column under ANSI rules.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return ratio(F.covar_pop(x, y), spread)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_two_sided(t: float, freedom: float) -> float:
    """Two-sided tail of Student's t, from the incomplete beta function."""
    return _incomplete_beta(freedom / 2.0, 0.5, freedom / (freedom + t * t))


def student_critical(freedom: float, level: float = 0.95) -> float:
    """The t for which the central mass is `level`, by bisection."""
    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2.0
        if student_two_sided(middle, freedom) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from its tail."""
    value = 0.0
    for m in range(300, 0, -1):
        half = m // 2
        if m % 2 == 0:
            term = half * (b - half) * x / ((a + m - 1) * (a + m))
        else:
            term = -(a + half) * (a + b + half) * x / ((a + m - 1) * (a + m))
        value = term / (1.0 + value)
    return 1.0 / (1.0 + value)
