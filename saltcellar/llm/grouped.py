"""Members of buckets, compared in blocks of bounded size by tasks that report sums instead of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of complete groups from batches that are sorted by `keys`; holds one group more than a batch at the most."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1][k].iloc[-1] != v[0] for k, v in zip(keys, values)):
            yield pd.concat(held, ignore_index=True)
            held = []
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if cut:
            held.append(batch.iloc[:cut])
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def spans(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    """First and last + 1 row of each group."""
    change = np.zeros(len(frame), dtype=bool)
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), len(frame)]
    return zip(cuts, cuts[1:])


def block_tasks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members (node, id, …) dealt to tasks (node, i, j): the two blocks of a task meet, so all pairs of a bucket do once.

    A bucket of n members has ceil(n / block) blocks by hash; a member goes to as many tasks as there are blocks, so rows grow
    with n * n / block while a task holds two blocks. Buckets of one member are dropped.
    """
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select("node", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "node").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def earlier_shared(nodes: list[np.ndarray], node: int) -> np.ndarray | None:
    """Which pairs already met in a bucket of a smaller number: such a pair is not counted again."""
    before = [x[x < node] for x in nodes]
    every = np.concatenate(before)
    if not len(every):
        return None
    values, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(nodes)), [len(x) for x in before])
    wanted = times[inverse] > 1
    if not wanted.any():
        return None
    column = np.cumsum(times > 1) - 1
    table = np.zeros((len(nodes), int((times > 1).sum())), dtype=np.float32)
    table[row[wanted], column[inverse[wanted]]] = 1
    return table @ table.T > 0


def link_report(ids: np.ndarray, weight: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """Rows (id, links, root) for the members with links: the summed weight of linked ones, and a spanning forest's root."""
    links = linked @ weight
    has = np.flatnonzero(linked.any(axis=1))
    root = np.arange(len(ids))
    while len(has):
        new = root.copy()
        for i in has:
            new[i] = min(root[i], root[linked[i]].min())
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"id": ids[has], "links": links[has].astype("int64"), "root": ids[root[has]]})


REPORT = "id bigint, links bigint, root bigint"
Kernel = Callable[[pd.DataFrame], pd.DataFrame]


def run_tasks(dealt: DataFrame, kernel: Kernel, schema: str = REPORT) -> DataFrame:
    """`kernel` over each (node, i, j) of dealt members."""

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["node", "i", "j"]
        for run in whole_groups(batches, keys):
            found = [kernel(run.iloc[a:b]) for a, b in spans(run, keys) if b - a > 1]
            found = [f for f in found if len(f)]
            if found:
                yield pd.concat(found, ignore_index=True)

    return dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInPandas(tasks, schema)
