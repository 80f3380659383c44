"""Line de-duplication: exact by hash, near by a segment-partition edit join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.shared import bind, sent_if_small, stored, text_of, whole_row

MOST_EDITS = 2
SHORTEST, SHORTEST_NEAR = 10, 40  # characters: shorter lines stay; below the second only equal lines are repeats
LENGTH_STEP = 16
COUNTED = tuple("etaoinsrhldcumfpbgw ,.é")  # characters whose numbers are compared before lines are


def normal_line(line: Column) -> Column:
    """Case and outer white space make no difference; other white space counts as characters."""
    return F.lower(F.trim(line))


def _segment_keys(line: Column, size: Column, most: int) -> Column:
    """Keys under which a line is indexed and looked up: array of (key, indexed).

    Lengths fall into classes of 16. In a class most + 1 disjoint segments have the class' own length: the first at the
    front, the last at the end, the others by offset. Two lines within `most` edits share an untouched segment i whose
    offset moved by at most i edits before it and the rest behind it, so segment i is looked up at these offsets. A line also
    looks into the class below when a shorter line within `most` edits could be there.
    """
    pieces = most + 1
    found = []
    for below in (0, 1):
        grade = F.floor((size - below * most) / LENGTH_STEP).cast("int")
        length = F.floor(grade * LENGTH_STEP / pieces).cast("int")
        for i in range(pieces):
            moves = range(-min(i, most - i), min(i, most - i) + 1)
            for move in moves:
                if i == pieces - 1 and i > 0:
                    start = size - length + 1 + move
                else:
                    start = length * i + 1 + move
                key = F.xxhash64(F.lit(i), grade, F.substring(line, start, length))
                entry = F.struct(key.alias("key"), F.lit(not below and move == 0).alias("indexed"))
                here = F.lit(True) if not below else grade < F.floor(size / LENGTH_STEP)
                found.append(F.when(here, entry))
    return F.when(size >= SHORTEST_NEAR, F.array_compact(F.array(*found)))


def line_table(documents: DataFrame, key: str, most: int = MOST_EDITS) -> DataFrame:
    """Judged lines of all documents: (doc, row, pos, id, id2, keys), without their texts."""
    lines = documents.select(
        F.col(key).alias("doc"), F.xxhash64(F.col(key), text_of("text")).alias("row"),
        F.posexplode(F.split(text_of("text"), "\n", -1)).alias("pos", "line"),
    )
    lines = lines.withColumn("line", normal_line("line")).withColumn("size", F.char_length("line")).filter(F.col("size") >= SHORTEST)
    return lines.select(
        "doc", "row", "pos", F.xxhash64("line").alias("id"), F.xxhash64("line", F.lit("second")).alias("id2"),
        _segment_keys(F.col("line"), F.col("size"), most).alias("keys"),
    )


def near_pairs(documents: DataFrame, lines: DataFrame, key: str, most: int = MOST_EDITS) -> DataFrame:
    """Pairs of different lines within `most` edits: (low, high), structs (id, id2)."""
    entries = lines.filter("keys IS NOT NULL").select("id", "id2", F.inline("keys"))
    # Most keys belong to one line: counting finds the others, combined before the shuffle however often a line repeats.
    shared = entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("indexed").alias("indexed"))
    shared = stored(shared.filter("low != high AND indexed").select(F.col("key").alias("shared")), "line-keys")
    kept = entries.join(sent_if_small(shared), F.col("key") == F.col("shared"), "left_semi")
    kept = stored(kept.groupBy("key", "id", "id2").agg(F.max("indexed").alias("indexed")), "line-entries")
    # Texts of the lines with such keys, one document each.
    wanted = kept.select(F.struct("id", "id2").alias("line")).distinct()
    places = lines.join(wanted, (F.col("id") == F.col("line.id")) & (F.col("id2") == F.col("line.id2")))
    places = places.groupBy("line").agg(F.min(F.struct("doc", "row", "pos")).alias("at"))
    places = sent_if_small(stored(places.select("line", "at.*"), "line-places"))
    texts = documents.select(F.col(key).alias("of"), text_of("text").alias("whole"))
    rows = texts.join(places, F.col("of").eqNullSafe(F.col("doc")) & (F.xxhash64("of", "whole") == F.col("row")))
    line = normal_line(F.element_at(F.split("whole", "\n", -1), F.col("pos") + 1))
    rows = rows.select("line", line.alias("text")).dropDuplicates(["line"])
    counts = [(F.char_length("text") - F.char_length(F.replace("text", F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(COUNTED)]
    rows = stored(rows.select("line", "text", F.char_length("text").alias("size"), *counts), "line-texts")
    numbers = ["size", *[f"c{i}" for i in range(len(COUNTED))]]
    sides = []
    for name in ("low", "high"):
        side = kept.join(rows, (F.col("id") == F.col("line.id")) & (F.col("id2") == F.col("line.id2")))
        sides.append(side.select("key", F.col("indexed").alias(f"{name}_indexed"), F.col("line").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in numbers]))
    # An edit changes the length by one at the most and the letter counts by two in all.
    apart = [F.abs(F.col(f"low_{c}") - F.col(f"high_{c}")) for c in numbers]
    possible = (F.col("low") < F.col("high")) & (F.col("low_indexed") | F.col("high_indexed")) & (apart[0] <= most) & (sum(apart[2:], apart[1]) <= 2 * most)
    pairs = sides[0].join(sides[1], "key").filter(possible).select("low", "high").distinct()
    one, two = (rows.select(F.col("line").alias(n), F.col("text").alias(f"{n}_text")) for n in ("low", "high"))
    compared = stored(pairs, "line-pairs").join(one, "low").join(two, "high")
    return compared.filter(within_edits(F.col("low_text"), F.col("high_text"), most)).select("low", "high")


def _without_common_front(pair: Column) -> Column:
    """Two lines without their common beginning, on which the distance does not depend, and turned round; a character stays."""
    a, b = pair["a"], pair["b"]
    powers = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])

    def longest(room: Column) -> Column:
        # Doubling steps downwards: a step is taken where it fits and that much more is equal.
        def step(held: Column, more: Column) -> Column:
            equal = (more <= room - held) & (F.substring(a, held + 1, more) == F.substring(b, held + 1, more))
            return F.when(equal, held + more).otherwise(held)

        return F.aggregate(powers, F.lit(0), step)

    front = bind(F.least(F.char_length(a), F.char_length(b)) - 1, longest)
    return bind(
        front, lambda p: F.struct(F.reverse(F.substring(a, p + 1, F.char_length(a))).alias("a"), F.reverse(F.substring(b, p + 1, F.char_length(b))).alias("b"))
    )


def within_edits(a: Column, b: Column, most: int) -> Column:
    """Whether two non-empty lines are within `most` edits: common ends are cut off, the middle goes through a bit-parallel band."""
    near = F.abs(F.char_length(a) - F.char_length(b)) <= most
    middle = bind(bind(F.struct(a.alias("a"), b.alias("b")), _without_common_front), _without_common_front)
    return F.when(near, bind(middle, lambda pair: _in_band(pair, most))).otherwise(False)


def _in_band(pair: Column, most: int) -> Column:
    """Banded bit-parallel edit distance of two lines whose lengths differ by `most` at the most.

    After j characters of b, bit c of band d says that the first j + c - most characters of a can be had with d edits. A
    band has 2 most + 1 bits, and the most + 1 bands stand side by side in one long, so `most` can be 4 at the most.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    first = sum(sum(1 << (most + e) for e in range(d + 1)) << (width * d) for d in range(most + 1))

    def step(chars: Column, state: Column, j: Column) -> Column:
        at = F.get(chars["b"], j)
        equal = [F.when(F.get(chars["a"], j + (c - most)) == at, F.lit(1 << c)).otherwise(F.lit(0)) for c in range(width)]
        return bind(sum(equal[1:], equal[0]).cast("long"), lambda match: moved(state, match))

    def moved(state: Column, match: Column) -> Column:
        old = [F.shiftright(state, width * d).bitwiseAND(F.lit(full)) for d in range(most + 1)]
        new = packed = old[0].bitwiseAND(match)
        for d in range(1, most + 1):
            # a matching or a replaced character; one more of b; one more of a
            new = old[d].bitwiseAND(match).bitwiseOR(old[d - 1]).bitwiseOR(F.shiftright(old[d - 1], 1)).bitwiseOR(
                F.shiftleft(new, 1).bitwiseAND(F.lit(full))
            )
            packed = packed.bitwiseOR(F.shiftleft(new, width * d))
        return packed

    size_a, size_b = F.char_length(pair["a"]), F.char_length(pair["b"])
    chars = F.struct(F.split(pair["a"], "").alias("a"), F.split(pair["b"], "").alias("b"))
    last = bind(
        chars, lambda both: F.aggregate(F.sequence(F.lit(0), size_b - 1), F.lit(first).cast("long"), lambda state, j: step(both, state, j))
    )
    end = F.call_function("shiftleft", F.lit(1).cast("long"), size_a - size_b + most)
    return F.shiftright(last, width * most).bitwiseAND(end) != 0


def repeated_lines(documents: DataFrame, key: str = "doc_id", most: int = MOST_EDITS) -> DataFrame:
    """Lines to take out: (doc, row, exact, near), arrays of line numbers from 0; documents without such lines are left out.

    A line repeats if an equal line (case and outer white space aside) or, from 40 characters on, one within two edits
    comes earlier in the order of (key, text hash, line number). The first of its kind stays.
    """
    lines = stored(line_table(documents, key, most), "lines")
    place = F.struct("doc", "row", "pos")
    classes = stored(lines.groupBy("id", "id2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-kinds")
    near = stored(near_pairs(documents, lines, key, most), "line-near")
    both = near.select(F.col("low").alias("line"), "low", "high").union(near.select("high", "low", "high"))
    firsts = classes.withColumn("line", F.struct("id", "id2")).join(both.select("line").distinct(), "line", "left_semi")
    firsts = stored(firsts.select("line", "first"), "line-firsts")
    low = firsts.select(F.col("line").alias("low"), F.col("first").alias("low_first"))
    high = firsts.select(F.col("line").alias("high"), F.col("first").alias("high_first"))
    later = near.join(low, "low").join(high, "high")
    later = later.select(F.when(F.col("low_first") < F.col("high_first"), F.col("high")).otherwise(F.col("low")).alias("line"))
    later = later.distinct().select(F.col("line.id").alias("id"), F.col("line.id2").alias("id2"), F.lit(True).alias("near"))
    judged = classes.join(later, ["id", "id2"], "left").filter("n > 1 OR near")
    judged = stored(judged.select("id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-classes")
    hits = lines.select("doc", "row", "pos", "id", "id2").join(judged, ["id", "id2"])
    exact = place != F.col("first")
    hits = hits.filter(exact | F.col("near"))
    return hits.groupBy("doc", "row").agg(
        F.collect_set(F.when(exact, F.col("pos"))).alias("exact"), F.collect_set(F.when(~exact, F.col("pos"))).alias("near")
    )


def dedup_lines(documents: DataFrame, key: str = "doc_id", most: int = MOST_EDITS) -> DataFrame:
    """Every row of `documents` with repeated lines taken out of its text, plus n_lines, n_exact and n_near.

    Lines are what stands between line feeds. Lines under 10 characters (so blank ones too) always stay; a null text becomes
    the empty text; rows that repeat key and text count as one document and stay equal; an empty table stays empty. All other columns
    stay; an input column named like one of the three new ones is replaced.
    """
    drops = sent_if_small(stored(repeated_lines(documents, key, most), "line-drops"))
    mine, whole = F.col(f"own.{key}"), text_of(F.col("own.text"))
    same = mine.eqNullSafe(F.col("doc")) & (F.xxhash64(mine, whole) == F.col("row"))
    joined = documents.select(whole_row(documents)).join(drops, same, "left").withColumn("lines", F.split(whole, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.concat("exact", "near"))
    text = F.array_join(F.transform(left, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    new = {
        "text": F.when(F.col("exact").isNull(), whole).otherwise(text), "n_lines": F.size("lines"),
        "n_exact": F.coalesce(F.size("exact"), F.lit(0)), "n_near": F.coalesce(F.size("near"), F.lit(0)),
    }
    counts = ("n_lines", "n_exact", "n_near")
    kept = [new["text"].alias(c) if c == "text" else F.col(f"own.`{c}`") for c in documents.columns if c not in counts]
    return joined.select(*kept, *[new[c].alias(c) for c in counts])
