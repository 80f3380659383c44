"""Embedding near-duplicates by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.components import components
from saltcellar.llm.grouped import block_tasks, link_report, run_tasks
from saltcellar.llm.shared import stored

COSINE, RECALL = 0.9, 0.995
LEAST_COLLISIONS = 2
WINDOW = 1.0  # half width of a query's window; projections of unit vectors have standard deviation 1
LIST_LENGTH = 32  # wanted mean length of a projection's list
LOWEST_TAIL, HIGHEST_TAIL = 2.0, 4.0
_SEED, _SLAB = 20_011, 2048


def _upper(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def _both_in_window(tail: float, cosine: float, window: float) -> float:
    """Chance that two unit vectors at this cosine both project beyond `tail` and within `window` of each other."""
    spread = math.sqrt(1.0 - cosine * cosine)
    total, step = 0.0, 0.01
    x = tail + step / 2
    while x < tail + 6:
        low, high = max(tail, x - window), x + window
        inside = _upper((low - cosine * x) / spread) - _upper((high - cosine * x) / spread)
        total += step * math.exp(-x * x / 2) / math.sqrt(2 * math.pi) * inside
        x += step
    return total


def calibrate(rows: int, cosine: float = COSINE, recall: float = RECALL, least: int = LEAST_COLLISIONS) -> tuple[float, int]:
    """Where lists begin (the tail) and how many directions it takes.

    The tail is set so that a list has about 32 of the rows; directions are added until a pair at the threshold has `least`
    collisions with the wanted recall (collisions of a pair are all but independent, so their number is Poisson).
    """
    low, high = LOWEST_TAIL, HIGHEST_TAIL
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if rows * _upper(middle) > LIST_LENGTH else (low, middle)
    tail = (low + high) / 2
    mean = 0.0
    while sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least)) > 1 - recall:
        mean += 0.05
    return tail, math.ceil(mean / (2 * _both_in_window(tail, cosine, WINDOW)))


def _unit(vectors: pd.Series) -> np.ndarray:
    table = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return table / np.linalg.norm(table, axis=1, keepdims=True)


def _hits(tail: float, directions: int, width: int):
    """The lists that a vector stands in, with its values: a list is a direction and a side."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.iloc[low : low + 1024]
                unit = _unit(part["vector"]).astype(np.float32)
                row, node, value = [], [], []
                for first in range(0, directions, _SLAB):
                    count = min(_SLAB, directions - first)
                    aims = np.random.default_rng([_SEED, first]).standard_normal((width, count), dtype=np.float32)
                    out = unit @ aims
                    for side, reach in ((0, out), (1, -out)):
                        r, c = np.nonzero(reach > tail)
                        row.append(r)
                        node.append((first + c) * 2 + side)
                        value.append(reach[r, c])
                row, node, value = np.concatenate(row), np.concatenate(node), np.concatenate(value)
                order = np.lexsort((node, row))
                cuts = np.searchsorted(row[order], np.arange(1, len(part)))
                yield part.assign(
                    nodes=np.split(node[order].astype(np.int64), cuts), values=np.split(value[order].astype(np.float64), cuts)
                )

    return project


def _compare(cosine: float, least: int):
    def kernel(task: pd.DataFrame) -> pd.DataFrame:
        here = task["node"].iloc[0]
        nodes = [np.asarray(x) for x in task["nodes"]]
        owner = np.repeat(np.arange(len(nodes)), [len(x) for x in nodes])
        every, value = np.concatenate(nodes), np.concatenate([np.asarray(x) for x in task["values"]])
        names, column, times = np.unique(every, return_inverse=True, return_counts=True)
        n = len(nodes)
        count, before, now = np.zeros((n, n), dtype=np.int16), np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)
        order = np.lexsort((value, column))
        ends = np.cumsum(times)
        for k in np.flatnonzero(times > 1):
            members = order[ends[k] - times[k] : ends[k]]  # one projection's list, sorted by value
            who, at = owner[members], value[members]
            met = np.zeros((n, n), dtype=bool)
            first, last = np.searchsorted(at, at - WINDOW), np.searchsorted(at, at + WINDOW, side="right")
            for query, a, b in zip(who, first, last):  # the window is centred on the query
                met[query, who[a:b]] = True
            count += met
            if names[k] < here:
                before |= met
            elif names[k] == here:
                now = met
        unit = _unit(task["vector"])
        linked = now & ~before & (count >= least) & (unit @ unit.T >= cosine)
        np.fill_diagonal(linked, False)
        if task["i"].iloc[0] != task["j"].iloc[0]:
            own = task["own"].to_numpy()
            linked &= own[:, None] != own[None, :]
        return link_report(task["id"].to_numpy(), task["n"].to_numpy(), linked)

    return kernel


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """One row per row of `vectors`: key, n_links, component_id, kept.

    Two vectors link when a pair at `cosine` or more (double precision) was found; none below it is linked. Vectors that are null or zero,
    hold a null or a value that is not finite, or have another length than their partner link with nothing. Equal vectors are
    one class and all link. component_id is the smallest key reachable, kept marks its row. A null key links as others do
    and names no component; repeated keys are compared row by row.

    Directions are random; each has two lists, the vectors beyond a tail on either side, sorted by their projection. A pair
    collides in a list if one stands in the window centred on the other. Pairs with at least two collisions are verified;
    `calibrate` sets the directions for the recall. A pair is judged once, in the first list it collides in, by a task that
    holds two blocks of the list at the most and reports link counts and a spanning forest, not pairs.
    """
    raw = F.col("vector")
    sound = F.coalesce(F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(raw, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.withColumn("class", F.when(sound, F.xxhash64("vector")))
    rows = rows.withColumn("check", F.when(sound, F.xxhash64("vector", F.lit("check"))))
    classes = rows.filter("class IS NOT NULL").groupBy("class", "check").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    classes = stored(classes.select(F.col("class").alias("id"), "n", "least", "vector", F.size("vector").alias("width")), "vector-classes")
    reports = None
    for width, number in sorted((r["width"], r["number"]) for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("number")).collect()):
        tail, directions = calibrate(number, cosine, recall)
        some = classes.filter(F.col("width") == width).select("id", "n", "vector")
        found = some.mapInPandas(_hits(tail, directions, width), "id bigint, n bigint, vector array<double>, nodes array<bigint>, values array<double>")
        found = stored(found, "vector-hits")
        members = found.select(F.explode("nodes").alias("node"), "id")
        report = run_tasks(block_tasks(members).join(found, "id"), _compare(cosine, LEAST_COLLISIONS))
        reports = report if reports is None else reports.union(report)
    if reports is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    reports = stored(reports, "vector-links")
    links = reports.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(reports.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("id", "n", "least").join(links, "id", "left").join(joined, F.col("id") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("id", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(stored(named, "vector-components"), F.col("class") == F.col("id"), "left")
    component = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("key")).alias("kept"),
    )
