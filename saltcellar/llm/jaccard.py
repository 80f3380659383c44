"""N-gram Jaccard self-join by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.components import components
from saltcellar.llm.grouped import block_tasks, earlier_shared, link_report, run_tasks, spans, whole_groups
from saltcellar.llm.shared import sent_if_small, small_batches, stored, text_of, whole_row
from saltcellar.llm.tokens import constants, mix, shingles, slabs, word_hashes

SHINGLE_WORDS, SIMILARITY = 5, 0.8
SKETCH = 128  # MinHash values of a set: the tokens that paths are sampled from
BUCKET = 256  # buckets up to this size are compared by brute force, larger ones are split on
DEPTH = 4  # after so many splits a bucket is compared in blocks, whatever its size
TARGET_RECALL = 0.999
# A pair at the wanted similarity agrees in so many sketch values or more but for 1 pair in a million.
AGREE_SIGMAS = 4.8


def path_survival(similarity: float, depth: int) -> float:
    """Chance that two sets of this similarity still share a bucket after `depth` splits.

    A bucket samples one token, and with chance 1/4 a second one: 1 / 0.8 on average, as chosen paths need at similarity 0.8.
    """
    alive = 1.0
    for _ in range(depth):
        lost = 1.0 - similarity * alive
        alive = 1.0 - (0.75 * lost + 0.25 * lost * lost)
    return alive


def runs_for(recall: float, similarity: float, depth: int) -> int:
    return math.ceil(math.log(1.0 - recall) / math.log(1.0 - path_survival(similarity, depth)))


_MULTIPLY = constants(SKETCH, 3)


def _sketch(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of non-empty sets laid end to end."""
    begin = np.cumsum(number) - number
    out = np.empty((len(number), SKETCH), dtype="<u4")
    for c in range(SKETCH):
        out[:, c] = np.minimum.reduceat(hashes * _MULTIPLY[c], begin) >> np.uint64(32)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in slabs(texts):
            words, counts = word_hashes(texts[part])
            hashes, number = shingles(words, counts, SHINGLE_WORDS)
            full = number > 0
            frame = batch.iloc[part].loc[full, ["text_id", "key"]].reset_index(drop=True)
            if not full.any():
                continue
            number = number[full]
            begin = np.cumsum(number) - number
            place = (np.arange(len(hashes)) - np.repeat(begin, number)).astype(np.uint64)
            # Equal word sequences have equal sums; two sums of 64 bits name a class.
            frame["class"] = _signed(np.add.reduceat(mix(hashes + place * constants(1, 4)[0]), begin))
            frame["check"] = _signed(np.add.reduceat(mix(hashes + place * constants(1, 5)[0]), begin))
            frame["sketch"] = [row.tobytes() for row in _sketch(hashes, number)]
            yield frame


def _tokens_of(node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tokens a bucket samples (index into the sketch), and which buckets sample them."""
    first, second = mix(node + np.uint64(11)), mix(node + np.uint64(12))
    every = np.ones(len(node), dtype=bool)
    token = first % np.uint64(SKETCH)
    other = (token + np.uint64(1) + second % np.uint64(SKETCH - 1)) % np.uint64(SKETCH)  # never the first: a name would repeat
    return [(token.astype(np.int64), every), (other.astype(np.int64), first >> np.uint64(62) == 0)]


def _children(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and names of the buckets that members go on to."""
    rows, names = [], []
    for token, chosen in _tokens_of(node):
        row = np.flatnonzero(chosen)
        value = sketch[row, token[row]].astype(np.uint64)
        rows.append(row)
        names.append(mix(node[row] * np.uint64(0xD6E8FEB86659FD93) + (token[row].astype(np.uint64) << np.uint64(32)) + value))
    return np.concatenate(rows), np.concatenate(names)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<u4").reshape(len(values), SKETCH)


def _roots(runs: int):
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(1_000_003))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sketch = _matrix(batch["sketch"])
            for seed in seeds:
                row, name = _children(np.full(len(batch), seed, dtype=np.uint64), sketch)
                yield pd.DataFrame({"node": _signed(name), "id": batch["class"].to_numpy()[row]})

    return start


def _deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        row, name = _children(batch["node"].to_numpy().view(np.uint64), _matrix(batch["sketch"]))
        yield pd.DataFrame({"node": _signed(name), "id": batch["id"].to_numpy()[row]})


def _buckets(sets: DataFrame, runs: int) -> DataFrame:
    """Leaf buckets (node, id, n) of n members, two or more, over all runs."""
    known = sets.select("class", "sketch")
    rows = stored(known.mapInPandas(_roots(runs), "node bigint, id bigint"), "paths")
    leaves = None
    for depth in range(1, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = stored(rows.join(sizes, "node"), "path-sizes")
        done = sized.filter(F.col("n") <= BUCKET) if depth < DEPTH else sized
        leaves = done if leaves is None else leaves.union(done)
        large = sized.filter(F.col("n") > BUCKET)
        if depth == DEPTH or large.isEmpty():
            break
        further = large.select("node", "id").join(known, F.col("id") == F.col("class")).select("node", "id", "sketch")
        # A set can reach a bucket by one path only, as names are made of the whole path.
        rows = stored(further.mapInPandas(_deeper, "node bigint, id bigint"), "paths")
    return leaves


def _near(table: np.ndarray, least: int, own: np.ndarray | None = None) -> np.ndarray:
    """Which rows agree with another row in `least` places; with `own`, only rows of another block count."""
    keep = np.zeros(len(table), dtype=bool)
    for low in range(0, len(table), 64):
        some = slice(low, min(low + 64, len(table)))
        same = (table[some, None, :] == table[None, :, :]).sum(axis=2)
        same[np.arange(len(same)), np.arange(low, low + len(same))] = -1
        if own is not None:
            same[own[some, None] == own[None, :]] = -1
        keep[some] = same.max(axis=1) >= least
    return keep


def _low_table(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), SKETCH)


def _agreeing(least: int):
    """Members of buckets of BUCKET members at the most that agree with another member in at least `least` sketch values."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in whole_groups(batches, ["node"]):
            table = _low_table(run["small"])
            keep = np.zeros(len(run), dtype=bool)
            cuts = np.array(list(spans(run, ["node"])))
            pairs = cuts[cuts[:, 1] - cuts[:, 0] == 2, 0]
            fits = (table[pairs] == table[pairs + 1]).sum(axis=1) >= least
            keep[pairs[fits]] = keep[pairs[fits] + 1] = True
            for a, b in cuts[cuts[:, 1] - cuts[:, 0] > 2]:
                keep[a:b] = _near(table[a:b], least)
            yield run.loc[keep, ["node", "id"]]

    return judge


def _agreeing_blocks(least: int):
    """The same for two blocks of a larger bucket."""

    def kernel(task: pd.DataFrame) -> pd.DataFrame:
        own = task["own"].to_numpy() if task["i"].iloc[0] != task["j"].iloc[0] else None
        return task.loc[_near(_low_table(task["small"]), least, own), ["node", "id"]]

    return kernel


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Rare shingles add pair by pair, frequent ones by products of 0/1 columns."""
    n = len(sets)
    if n == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]], dtype=np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    edge = np.flatnonzero(np.diff(every, prepend=every[:1] - np.uint64(1)) != 0)
    times = np.diff(edge, append=len(every))
    out = np.zeros((n, n), dtype=np.float64)
    for k in range(2, 9):
        at = edge[times == k]
        for x in range(k):
            for y in range(x + 1, k):
                cells = np.bincount(owner[at + x] * n + owner[at + y], minlength=n * n)
                out += cells.reshape(n, n)
    out += out.T
    often = np.flatnonzero(times > 8)
    for low in range(0, len(often), 2048):
        some = often[low : low + 2048]
        table = np.zeros((n, len(some)), dtype=np.float32)
        column = np.repeat(np.arange(len(some)), times[some])
        rows = np.concatenate([owner[e : e + t] for e, t in zip(edge[some], times[some])])
        table[rows, column] = 1
        out += table @ table.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _verify(similarity: float):
    def kernel(task: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, dtype="<u8") for s in task["shingles"]]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        common = _common(sets)
        linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        own = task["own"].to_numpy()
        if task["i"].iloc[0] != task["j"].iloc[0]:
            linked &= own[:, None] != own[None, :]
        met = earlier_shared([np.asarray(x) for x in task["nodes"]], task["node"].iloc[0])
        if met is not None:
            linked &= ~met
        return link_report(task["id"].to_numpy(), task["n"].to_numpy(), linked)

    return kernel


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in slabs(texts):
            words, counts = word_hashes(texts[part])
            hashes, number = shingles(words, counts, SHINGLE_WORDS)
            sets = [np.unique(x).astype("<u8").tobytes() for x in np.split(hashes, np.cumsum(number)[:-1])]
            yield pd.DataFrame({"id": batch["id"].iloc[part].to_numpy(), "n": batch["n"].iloc[part].to_numpy(), "shingles": sets})


def similar_documents(
    documents: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY, recall: float = TARGET_RECALL
) -> DataFrame:
    """For every row of `documents`: key, class_id, n_links, group_id, kept.

    Words are runs of letters and digits in lower case; a set is a text's five-word shingles (all its words where it has
    fewer than five). Texts of one word sequence form a class, named by its smallest key. n_links counts the other rows at a
    Jaccard similarity of `similarity` or more, group_id is the smallest key reachable by links, and kept marks the row of that
    key. Texts without words link with nothing. Rows with a null key link as others do, but are never kept where their group has a key; a
    group of null keys only keeps all its rows. Rows that repeat key and text are linked to each other and kept together.

    Each set's 128 MinHash values are its tokens. In every run a bucket samples one or two tokens, which its members share by
    the seed of the bucket, and members part by the token's value, until a bucket is small or four deep. Buckets drop members
    whose sketches agree with no other, large ones block by block; what is left is compared exactly. As many runs are made as bring a pair at the threshold
    to the target recall. A large bucket that does not part is compared in blocks, so no task holds it and no pair is written.
    """
    return _judged(documents, key, similarity, recall).drop("own_text")


def _judged(documents: DataFrame, key: str, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> DataFrame:
    """`similar_documents` with own_text, the hash of key and text, by which rows of one key are told apart."""
    texts = small_batches(documents).select(
        F.struct(F.col(key).alias("key")).alias("at"), F.xxhash64(F.col(key), text_of("text")).alias("text_id"), text_of("text").alias("text")
    )
    kind = documents.schema[key].dataType.simpleString()
    schema = f"text_id bigint, key {kind}, class bigint, `check` bigint, sketch binary"
    hashed = stored(texts.select("text_id", "at.key", "text").mapInPandas(_sketches, schema), "sketches")
    place = F.struct("key", "text_id")
    sets = hashed.groupBy(F.col("class").alias("hash"), "check").agg(
        F.min("sketch").alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(place).alias("place"), F.min("key").alias("name")
    )
    # Classes are told apart by 128 bits and numbered, so that no two share a number.
    sets = stored(sets.withColumn("class", F.monotonically_increasing_id()), "sets")
    leaves = _buckets(sets, runs_for(recall, similarity, DEPTH))
    # The low byte of each sketch value is enough to tell agreement from chance.
    least = int(SKETCH * similarity - AGREE_SIGMAS * math.sqrt(SKETCH * similarity * (1 - similarity)))
    small = sets.select("class", _low_bytes("sketch").alias("small"))
    pair = "node bigint, id bigint"
    leaves = leaves.join(small, F.col("id") == F.col("class")).select("node", "id", "n", "small")
    whole = leaves.filter(F.col("n") <= BUCKET).select("node", "id", "small")
    whole = whole.repartition("node").sortWithinPartitions("node").mapInPandas(_agreeing(least), pair)
    dealt = block_tasks(leaves.filter(F.col("n") > BUCKET).select("node", "id", "small"))
    judged = stored(whole.union(run_tasks(dealt, _agreeing_blocks(least), pair).distinct()), "agreeing")
    # Buckets of the same members are compared once.
    mark = F.xxhash64("id", F.lit("mark"))
    alike = judged.groupBy("node").agg(F.bit_xor(mark).alias("mark"), F.min("id").alias("first"), F.count(F.lit(1)).alias("m"))
    chosen = alike.groupBy("mark", "first", "m").agg(F.min("node").alias("node")).select("node")
    members = stored(judged.join(chosen, "node", "left_semi"), "members")
    paths = members.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    wanted = stored(sets.join(paths, F.col("class") == F.col("id")).select("id", "n", "place.*", "nodes"), "wanted")
    places = sent_if_small(wanted.select("id", "n", "key", F.col("text_id").alias("of")))
    found = texts.join(places, F.col("at.key").eqNullSafe(F.col("key")) & (F.col("text_id") == F.col("of")))
    found = found.select("id", "n", "text").dropDuplicates(["id"])
    payload = stored(found.mapInPandas(_shingle_sets, "id bigint, n bigint, shingles binary"), "shingles")
    dealt = block_tasks(members).join(payload, "id").join(wanted.select("id", "nodes"), "id")
    report = stored(run_tasks(dealt, _verify(similarity)), "reports")
    links = report.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(report.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = sets.select("class", "n", F.col("name").alias("class_id")).join(links, F.col("class") == F.col("id"), "left").drop("id")
    named = named.join(joined, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    groups = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    named = stored(named.join(groups, "component"), "classes").select(
        "class", "class_id", "group_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    rows = hashed.select(F.col("key").alias("own_key"), "text_id", F.col("class").alias("hash"), "check").distinct()
    rows = rows.join(sets.select("hash", "check", "class"), ["hash", "check"]).drop("hash", "check")
    rows = stored(rows.join(named, "class"), "document-classes")
    out = documents.select(F.col(key).alias("own"), F.xxhash64(F.col(key), text_of("text")).alias("own_text"))
    out = out.join(rows, F.col("own").eqNullSafe(F.col("own_key")) & (F.col("own_text") == F.col("text_id")), "left")
    grouped = F.when(F.col("class").isNull(), F.col("own")).otherwise(F.col("group_id"))
    classed = F.when(F.col("class").isNull(), F.col("own")).otherwise(F.col("class_id"))
    return out.select(
        F.col("own").alias(key), classed.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), grouped.alias("group_id"),
        grouped.eqNullSafe(F.col("own")).alias("kept"), "own_text",
    )


def _low_bytes(sketch: str):
    @F.pandas_udf("binary")
    def low(values: pd.Series) -> pd.Series:
        return values.map(lambda s: s[::4])

    return low(F.col(sketch))


def keep_one(documents: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The documents of which one of each group of similar ones stays, with all their columns."""
    gone = _judged(documents, key, **settings).filter(~F.col("kept")).select(F.col(key).alias("gone"), "own_text").distinct()
    gone = sent_if_small(stored(gone, "similar"))
    mine = F.col(f"own.{key}")
    same = mine.eqNullSafe(F.col("gone")) & (F.xxhash64(mine, text_of(F.col("own.text"))) == F.col("own_text"))
    return documents.select(whole_row(documents)).join(gone, same, "left_anti").select("own.*")
