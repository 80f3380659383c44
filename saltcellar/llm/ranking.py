"""Ranked lexical search: posting lists in blocks of similar documents, skipped only by exact bounds of their maxima."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltcellar.llm.shared import sent_if_small, small_batches, stored, text_of

TOP = 20
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FILTER_BITS = 24  # places of the term filter that tasks get: 2 MB, whatever the items hold
BLOCK_ROWS = 8
SHARD_ENTRIES = 1 << 19  # (document, term) entries that a task holds while it cuts blocks
SEED_ROWS = 4096  # documents of an item's rarest terms that are looked at for a first bound
GROUP_TERMS = 1 << 20  # (item, term) rows of one pass of the block builder, and of what is broadcast for it
SKETCH = 16


def terms_of(text: str) -> Counter:
    """64-bit codes of the terms of a whole text and how often each stands there; only A-Z are lower-cased."""
    found = Counter(TERM.findall(text.encode("utf-8", "replace").lower()))
    return Counter({xxhash.xxh64_intdigest(t) - (1 << 63): n for t, n in found.items()})


def _entries(texts: list[str], bits: np.ndarray | None):
    """Per text: number of terms; flat codes and counts of the terms that pass the filter, with offsets."""
    sizes, offsets, codes, counts = [], [0], [], []
    for text in texts:
        found = terms_of(text)
        sizes.append(sum(found.values()))
        code, count = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        if bits is not None:
            place = code & ((1 << FILTER_BITS) - 1)
            passed = (bits[place >> 3] >> (place & 7)) & 1 == 1
            code, count = code[passed], count[passed]
        codes.append(code)
        counts.append(count)
        offsets.append(offsets[-1] + len(code))
    empty = [np.empty(0, np.int64)]
    return sizes, np.array(offsets, np.int32), np.concatenate(empty + codes), np.concatenate(empty + counts)


def vectors(rows: DataFrame, key: str, term_bits: bytes | None, label: str) -> DataFrame:
    """(row, _key, n, codes, tfs) of each row, stored. `row` numbers the rows; `n` counts all terms, the lists hold those that pass."""
    sent = rows.sparkSession.sparkContext.broadcast(term_bits) if term_bits is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8) if sent is not None else None
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            sizes, offsets, codes, counts = _entries(batch.column(1).to_pylist(), bits)
            numbers = pa.array(np.arange(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (codes, counts)]
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["row", "_key", "n", "codes", "tfs"])

    read = small_batches(rows).select(F.col(key).alias("_key"), text_of("text").alias("_text"))
    kind = rows.schema[key].dataType.simpleString()
    return stored(read.mapInArrow(cut, f"row long, _key {kind}, n long, codes array<long>, tfs array<long>"), label)


def term_filter(terms: DataFrame) -> bytes:
    """A bit for each place that a term's code falls on, of fixed size: what has no bit is in no item."""
    place = F.col("term").bitwiseAND((1 << FILTER_BITS) - 1) + 1
    parts = terms.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for found in parts.collect():  # 512 parts of 4 KB at most
        out[(found["part"] - 1) * 4096 : found["part"] * 4096] = np.frombuffer(found["bits"], np.uint8)
    return out.tobytes()


@dataclass
class Totals:
    documents: int
    terms: int

    def impact(self, tf, n):
        """What one term adds at weight 1, rounding down: columns in Spark, arrays in numpy."""
        length = 75 + (25 * n * self.documents) // max(self.terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * length)

    def impact_column(self) -> Column:
        return F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {self.documents}L) div {max(self.terms, 1)}L))")


def postings(rows: DataFrame, totals: Totals, *columns: str) -> DataFrame:
    """(columns, term, impact) rows of stored vectors."""
    flat = rows.select(*columns, "n", F.explode(F.arrays_zip("codes", "tfs")).alias("e"))
    flat = flat.select(*columns, "n", F.col("e.codes").alias("term"), F.col("e.tfs").alias("tf"))
    return flat.select(*columns, "term", totals.impact_column().alias("impact"))


def weighed_items(items: DataFrame, rows: DataFrame, totals: Totals) -> DataFrame:
    """(item, term, gain, df, most, place, upto): a term's weight times its repeats in the item, the most that it adds to any
    document, its place in the item from the weakest on, and what it and all weaker ones add at the most."""
    asked = items.select(F.col("row").alias("item"), F.explode(F.arrays_zip("codes", "tfs")).alias("e"))
    asked = asked.select("item", F.col("e.codes").alias("term"), F.col("e.tfs").alias("repeats"))
    known = stored(asked.select("term").distinct(), "search-vocabulary")
    seen = postings(rows, totals).join(sent_if_small(known), "term").groupBy("term")
    seen = seen.agg(F.count("*").alias("df"), F.max("impact").alias("highest"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * totals.documents + 2)) / (2.0 * F.col("df") + 1))).cast("long")
    gain = F.col("repeats") * weight
    found = asked.join(seen, "term").select("item", "term", gain.alias("gain"), "df", (gain * F.col("highest")).alias("most"))
    weakest = Window.partitionBy("item").orderBy("most", "term")
    placed = found.filter("gain > 0").withColumns({"place": F.row_number().over(weakest), "upto": F.sum("most").over(weakest)})
    return stored(placed, "search-terms")


def exact_scores(pairs: DataFrame, rows: DataFrame, asked: DataFrame, totals: Totals) -> DataFrame:
    """(item, row, _key, score) of each (item, row) pair: every term of the item counts."""
    wanted = pairs.join(rows, "row")
    each = postings(wanted, totals, "item", "row", "_key").join(sent_if_small(asked.select("item", "term", "gain")), ["item", "term"])
    return each.groupBy("item", "row", "_key").agg(F.sum(F.col("gain") * F.col("impact")).alias("score"))


def first_bounds(rows: DataFrame, asked: DataFrame, totals: Totals, top: int) -> DataFrame:
    """(item, bound): the score of the `top`-th of some documents scored exactly. Any documents give a bound that holds.

    Tried are those with the highest sums over the item's rarest terms, as many terms as `SEED_ROWS` postings hold, one at least.
    """
    rarest = Window.partitionBy("item").orderBy("df", "term")
    upto = asked.withColumns({"upto": F.sum("df").over(rarest), "place": F.row_number().over(rarest)})
    seeds = upto.filter((F.col("upto") <= SEED_ROWS) | (F.col("place") == 1)).select("item", "term", "gain")
    partial = postings(rows, totals, "row").join(sent_if_small(stored(seeds, "search-rarest")), "term").groupBy("item", "row").agg(F.sum(F.col("gain") * F.col("impact")).alias("part"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part"), "row"))
    tried = partial.withColumn("place", best).filter(F.col("place") <= 2 * top).select("item", "row")
    scored = exact_scores(stored(tried, "search-seeds"), rows, asked, totals)
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
    return stored(ranked.filter(F.col("place") == top).select("item", F.col("score").alias("bound")), "search-bounds")


def needed_lists(asked: DataFrame, bounds: DataFrame) -> DataFrame:
    """(item, term, place, bound): the lists that an item must look into.

    Terms so weak that all up to them stay below the bound can't lift a document to it alone.
    """
    bound = F.coalesce("bound", F.lit(1).cast("long"))
    reached = asked.join(bounds, "item", "left").filter(F.col("upto") >= bound)
    return reached.select("item", "term", "place", bound.alias("bound"))


@dataclass
class Lists:
    """What the block builder is told: known codes in order, their weights, and for each list the places of its coordinates."""

    codes: np.ndarray
    weights: np.ndarray
    lists: np.ndarray
    starts: np.ndarray
    coordinates: np.ndarray


def _lists(asked: DataFrame, needed: DataFrame) -> Lists:
    """Of one group of items: at most `GROUP_TERMS` rows, unless one item alone has more."""
    all_terms = asked.select("item", "term", "gain").toPandas()
    lists = needed.select("item", "term").toPandas()
    codes, place = np.unique(all_terms["term"].to_numpy(np.int64), return_inverse=True)
    weights = np.zeros(len(codes))
    np.maximum.at(weights, place, all_terms["gain"].to_numpy(np.float64))
    of_item = {item: place[at] for item, at in all_terms.groupby("item").indices.items()}
    parts: dict[int, list[np.ndarray]] = {}
    for item, term in zip(lists["item"].tolist(), np.searchsorted(codes, lists["term"].to_numpy(np.int64)).tolist()):
        parts.setdefault(term, []).append(of_item[item])
    order = sorted(parts)
    merged = [np.unique(np.concatenate(parts[t])) for t in order]
    starts = np.cumsum([0, *map(len, merged)])
    return Lists(codes, weights, np.array(order, np.int64), starts, np.concatenate([np.empty(0, np.int64), *merged]).astype(np.int64))


def cluster(sketches: np.ndarray, size: int) -> np.ndarray:
    """Block of each vector: every vector goes to the most similar of evenly drawn ones, blocks over `size` are cut."""
    n = len(sketches)
    if n <= size:
        return np.zeros(n, np.int64)
    drawn = np.arange(0, n, size)
    nearest = np.empty(n, np.int64)
    for low in range(0, n, 4096):
        nearest[low : low + 4096] = (sketches[low : low + 4096] @ sketches[drawn].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    starts = np.searchsorted(nearest[order], nearest[order])
    block = np.empty(n, np.int64)
    names = nearest[order] * n + (np.arange(n) - starts) // size
    block[order] = np.unique(names, return_inverse=True)[1]
    return block


def shard_blocks(lists: Lists, size: int, row: np.ndarray, starts: np.ndarray, code: np.ndarray, impact: np.ndarray) -> Iterator[tuple]:
    """(list, rows, coordinates, maxima) of the blocks of each needed list within some documents; codes are places in `lists.codes`."""
    owner = np.repeat(np.arange(len(row)), np.diff(starts))
    strength = impact * lists.weights[code]
    names = lists.codes[code]
    sketches = np.empty((len(row), SKETCH))
    for d in range(SKETCH):  # the bits of a term's code are the signs of its projections
        sketches[:, d] = np.bincount(owner, np.where((names >> d) & 1 == 1, strength, -strength), len(row))
    sketches /= np.maximum(np.linalg.norm(sketches, axis=1), 1e-9)[:, None]
    order = np.argsort(code, kind="stable")
    low, high = np.searchsorted(code[order], lists.lists), np.searchsorted(code[order], lists.lists, side="right")
    wanted = np.zeros(len(lists.codes), bool)
    for k in np.flatnonzero(high > low).tolist():
        members = owner[order[low[k] : high[k]]]
        block = cluster(sketches[members], size)
        coordinates = lists.coordinates[lists.starts[k] : lists.starts[k + 1]]
        lengths = starts[members + 1] - starts[members]
        places = np.repeat(starts[members] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        wanted[coordinates] = True
        kept = wanted[code[places]]
        wanted[coordinates] = False
        name = np.repeat(block, lengths)[kept] * len(lists.codes) + code[places][kept]
        sorting = np.argsort(name, kind="stable")
        name, value = name[sorting], impact[places][kept][sorting]
        first = np.flatnonzero(np.append(True, np.diff(name) != 0))
        maxima, name = np.maximum.reduceat(value, first), name[first]
        by_block = np.argsort(block, kind="stable")
        count = int(block.max()) + 1
        row_cuts = np.searchsorted(block[by_block], np.arange(count + 1))
        name_cuts = np.searchsorted(name, np.arange(count + 1) * len(lists.codes))
        for b in range(count):
            at = slice(name_cuts[b], name_cuts[b + 1])
            yield int(lists.lists[k]), row[members[by_block[row_cuts[b] : row_cuts[b + 1]]]], name[at] % len(lists.codes), maxima[at]


def blocks(rows: DataFrame, totals: Totals, lists: Lists, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(term, block, rows, coordinates, maxima), stored: the needed lists, each cut where the documents lie."""
    sent = rows.sparkSession.sparkContext.broadcast(lists)
    names = ["term", "block", "rows", "coordinates", "maxima"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        number = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        size = 0
        for batch in batches:
            n, codes, tfs = (batch.column(i) for i in (1, 2, 3))
            lengths = np.diff(codes.offsets.to_numpy())
            code = codes.flatten().to_numpy()
            place = np.minimum(np.searchsorted(known.codes, code), len(known.codes) - 1)
            real = known.codes[place] == code
            impact = totals.impact(tfs.flatten().to_numpy(), np.repeat(n.to_numpy(), lengths))
            owner = np.repeat(np.arange(len(lengths)), lengths)[real]
            held.append((batch.column(0).to_numpy(), np.bincount(owner, minlength=len(lengths)), place[real], impact[real]))
            size += len(owner)
            if size >= SHARD_ENTRIES:
                yield from _block_rows(known, block_rows, held, number, names)
                number, held, size = number + size + 1, [], 0
        if held:
            yield from _block_rows(known, block_rows, held, number, names)

    read = rows.select("row", "n", "codes", "tfs").filter(F.size("codes") > 0)
    return stored(read.mapInArrow(build, "term long, block long, rows array<long>, coordinates array<long>, maxima array<long>"), "search-blocks")


def _block_rows(known: Lists, size: int, held: list[tuple], number: int, names: list[str], most: int = 4096) -> Iterator[pa.RecordBatch]:
    row, lengths, code, impact = (np.concatenate([h[i] for h in held]) for i in range(4))
    found = []

    def sent() -> pa.RecordBatch:
        columns = [pa.array([int(known.codes[f[0]]) for f in found], pa.int64()), pa.array(np.arange(number, number + len(found)), pa.int64())]
        columns += [pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([known.codes[f[2]] for f in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([f[3] for f in found], pa.list_(pa.int64()))], names=names)

    for block in shard_blocks(known, size, row, np.append(0, np.cumsum(lengths)), code, impact):
        found.append(block)
        if len(found) >= most:
            yield sent()
            number, found = number + len(found), []
    if found:
        yield sent()


def surviving_pairs(cut: DataFrame, asked: DataFrame, needed: DataFrame) -> DataFrame:
    """(item, row) of the blocks whose maxima, taken together, reach the item's bound.

    A document is looked for in the list of the strongest of its terms: there stronger terms add nothing, so a block's sum goes
    over the list's own term and weaker ones.
    """
    each = cut.join(sent_if_small(needed), "term").select("item", "bound", "block", "place", F.explode(F.arrays_zip("coordinates", "maxima")).alias("c"))
    each = each.select("item", "bound", "block", F.col("place").alias("strongest"), F.col("c.coordinates").alias("term"), F.col("c.maxima").alias("most"))
    terms = asked.select("item", "term", "gain", "place")
    sums = each.join(sent_if_small(terms), ["item", "term"]).filter("place <= strongest").groupBy("item", "block", "bound")
    passed = sums.agg(F.sum(F.col("gain") * F.col("most")).alias("highest")).filter(F.col("highest") >= F.col("bound")).select("item", "block")
    members = cut.select("block", F.explode("rows").alias("row"))
    return passed.join(members, "block").select("item", "row").distinct()


def _groups(asked: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of items with at most `most` terms together."""
    sizes = asked.groupBy("item").agg(F.count("*").alias("size")).orderBy("item")
    out, start, held, last = [], None, 0, None
    for item in sizes.toLocalIterator():
        if start is not None and held + item["size"] > most:
            out.append((start, last))
            start, held = None, 0
        start = item["item"] if start is None else start
        held, last = held + item["size"], item["item"]
    return out + ([(start, last)] if start is not None else [])


def search(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", top: int = TOP,
           group_terms: int = GROUP_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The `top` highest-scoring rows of `documents` for each row of `items`: item_key, rank, key, score.

    Documents are cut into terms once and kept as stored vectors of the items' terms. Some documents of the rarest terms are
    scored to bound each item's last place from below; lists that can't reach it are left out; the others are cut into blocks
    of similar documents that keep the maximum of each coordinate which an item of the list asks for. A block is skipped only
    if the item's sum over its maxima stays below the bound; rows of the others are scored exactly, so the result is exact.
    Null and empty texts hold no terms and are never found; items without known terms give no row; repeated rows rank each, ties
    by key, nulls first; extra columns are not looked at. Terms are told apart by 64-bit hashes. Item lists beyond `group_terms` rows
    are served in several passes over the vectors.
    """
    wanted = vectors(items, item_key, None, "search-items")
    rows = vectors(documents, key, term_filter(wanted.select(F.explode("codes").alias("term"))), "search-vectors")
    counted = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    totals = Totals(counted["documents"], counted["terms"])
    asked = weighed_items(wanted, rows, totals)
    needed = stored(needed_lists(asked, first_bounds(rows, asked, totals, top)), "search-lists")
    pairs = [wanted.select(F.col("row").alias("item"), "row").limit(0)]
    for low, high in _groups(asked, group_terms):
        inside = F.col("item").between(low, high)
        mine, lists = asked.filter(inside), needed.filter(inside)
        pairs.append(stored(surviving_pairs(blocks(rows, totals, _lists(mine, lists), block_rows), mine, lists), "search-pairs"))
    found = pairs[0]
    for part in pairs[1:]:
        found = found.union(part)
    scored = exact_scores(found, rows, asked, totals).filter("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "_key", "row")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = wanted.select(F.col("row").alias("item"), F.col("_key").alias(item_key))
    return names.join(ranked, "item").select(item_key, "rank", F.col("_key").alias(key), "score")
