"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltcellar.llm.shared import stored, text_of

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """Targets of the sources: (source, source_size) in, plus (target, whole, part) out.

    Sources by code point, null last, take the weights in turn and share the whole size of the table. A target stops at
    `most_repeats` times its source; what it leaves is shared again by weight. That is a water level: with sources ordered by
    the level at which they fill up, a source is full when the level over it and all later ones reaches its own.
    `whole` times every document and `part` further words make up a target. One row per source: the windows without key see
    only sources. An empty table gives no row; sources without words have target 0.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(listed) - 1) % len(weights) + 1)
    full = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * most_repeats)
    full = full.withColumn("fills_at", F.col("most") / F.col("weight"))
    filling = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before, after, everywhere = (
        filling.rowsBetween(Window.unboundedPreceding, -1),
        filling.rowsBetween(0, Window.unboundedFollowing),
        Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = full.withColumn("level", left / F.sum("weight").over(after))
    level = level.withColumn("is_full", F.col("fills_at") <= F.col("level"))
    level = level.withColumn("at", F.max(F.when(~F.col("is_full"), F.col("level"))).over(everywhere))
    target = F.when(F.col("is_full"), F.col("most").cast("double")).otherwise(F.col("at") * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    done = level.withColumn("target", target).withColumn("whole", whole)
    part = F.col("target") - F.col("whole") * F.col("source_size")
    return done.select("source", "source_size", "target", "whole", part.alias("part"))


def hash_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The hash below which a document is taken once more, and how many of the rows at that hash are: (source, …) in, plus `cut`,
    `extra` and `edge_size` (of a row at the cut) out.

    Sizes are summed by source and leading hash bits; the bucket in which the sum passes `part` is the only one that the
    next level looks into, so each level is one map-side combined aggregate. At the last level a bucket is one hash, that of equal
    rows; as many of them are taken as end nearest to the target. A larger `part` only moves the cut up: budgets are nested.
    """
    part = F.least(F.col("part"), F.col("source_size").cast("double"))
    edge = targets.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("prefix"), part.alias("rest"))
    steps = HASH_BITS // LEVEL_BITS
    for step in range(1, steps + 1):
        bucket = F.shiftright("hash", HASH_BITS - LEVEL_BITS * step)
        inside = F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("prefix"))
        rows = sized.withColumn("bucket", bucket).join(edge, inside)
        sums = rows.groupBy("of", "bucket", "rest").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("held").over(Window.partitionBy("of").orderBy("bucket"))
        passed = sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("rest"))
        first = passed.groupBy("of").agg(F.min_by(F.struct("bucket", "held", "upto", "rest", "n"), "bucket").alias("hit"))
        below = F.col("hit.rest") - (F.col("hit.upto") - F.col("hit.held"))
        edge = first.select("of", F.col("hit.bucket").alias("prefix"), below.alias("rest"), F.col("hit.held").alias("held"), F.col("hit.n").alias("n"))
        edge = edge if step == steps else edge.drop("held", "n")
    # Half a document decides: what it adds beyond the target against what is missing without it.
    extra = F.coalesce(F.floor(F.try_divide(F.col("rest") * F.col("n"), F.col("held")) + 0.5), F.lit(0)).cast("long")
    found = targets.join(edge, F.col("source").eqNullSafe(F.col("of")))
    edge_size = (F.col("held") / F.col("n")).cast("long")
    return found.select("source", "source_size", "target", "whole", F.col("prefix").alias("cut"), extra.alias("extra"), edge_size.alias("edge_size"))


def row_hash(*columns: Column) -> Column:
    """60 bits of the MD5 of columns written as text, one a line (null as empty): any SQL engine can compute it."""
    lines = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\n", *lines).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    documents: DataFrame, weights: Sequence[int] = (1, 2, 3), most_repeats: int = 3, key: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """How often each document goes into a mix in which sources have their target shares.

    Returns the key, the columns in `keep`, size, source_size, target, copies and taken (size x copies). Copies depend on the hash of
    key, text and kept columns and on the source's sums alone: reruns agree, no sort of documents. Only rows that are equal in all of
    these share a hash; where the cut falls among them they are counted and dealt out one by one, so `taken` of a source ends
    within half a document of its target, however often keys and texts repeat. No document is taken more than `most_repeats`
    times. Null text has size 0; null sources form one source; an empty table gives no row. Extra columns are not looked at.
    """
    kept = [c for c in keep if c != key]
    own = F.struct(F.col(key), *[F.col(c) for c in kept]).alias("row")
    named = row_hash(F.col(key), F.col("text"), *[F.col(c) for c in kept if c != "text"]).alias("hash")
    measured = documents.select(own, F.col("source").alias("of"), named, word_count(F.col("text")).alias("size"))
    # Without further columns the measured rows are small and kept; else the table is read again rather than copied.
    sized = stored(measured if not kept else measured.drop("row"), "mix-sizes")
    rows = measured if kept else sized
    by_source = sized.withColumnRenamed("of", "source")
    totals = by_source.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = stored(hash_cuts(by_source, source_targets(totals, weights, most_repeats)), "mix-cuts")
    of_source = F.col("of").eqNullSafe(F.col("source"))
    plain = rows.join(cuts, of_source & (F.col("hash") != F.col("cut"))).withColumn("more", (F.col("hash") < F.col("cut")).cast("long"))
    columns = ["row", "size", "source_size", "target", "whole", "more"]
    chosen = plain.select(*columns).union(_dealt(rows.select("row", "of", "hash").join(cuts, of_source & (F.col("hash") == F.col("cut")))).select(*columns))
    chosen = chosen.withColumn("copies", F.least(F.col("whole") + F.col("more"), F.lit(most_repeats)))
    return chosen.select("row.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _dealt(equal: DataFrame, run: int = 4096) -> DataFrame:
    """The rows at the cuts, numbered: equal rows are counted where they lie, and `extra` of them are taken once more.

    A row that stands there very often is written out again in runs that go to several tasks.
    """
    counted = equal.groupBy("row", F.col("edge_size").alias("size"), "source_size", "target", "whole", "extra").agg(F.count(F.lit(1)).alias("n"))
    runs = counted.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))))
    runs = runs.repartition(F.xxhash64("start", "extra", "target"))
    numbered = runs.withColumn("number", F.explode(F.sequence("start", F.least(F.col("start") + run, F.col("n")) - 1)))
    return numbered.withColumn("more", (F.col("number") < F.col("extra")).cast("long"))
