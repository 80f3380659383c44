"""Connected components of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from links (a, b): the component is its smallest node; nodes without links do not appear.

    Every round points the neighbours of a node at the smallest one around, first those larger than the node, then those
    smaller. Rows never grow beyond the links, a star stays as it is, and the number of rounds grows with the logarithm of the
    nodes. The driver sees one count per round.
    """
    links = edges.filter("a != b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    links = stored(links, "links")
    while True:
        both = links.select(F.col("high").alias("node"), F.col("low").alias("other")).union(links.select("low", "high"))
        least = both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
        large = both.join(least, "node").filter("other > node").select(F.col("least").alias("low"), F.col("other").alias("high"))
        large = large.filter("low != high").distinct()
        small = large.groupBy("high").agg(F.min("low").alias("least"))
        joined = large.join(small, "high")
        down = joined.select(F.col("least").alias("low"), F.col("high"))
        across = joined.filter("low != least").select(F.col("least").alias("low"), F.col("low").alias("high"))
        new = stored(down.union(across).distinct(), "links")
        # Stars throughout: every node points at a root, and no root points on.
        parents = new.groupBy("high").agg(F.count(F.lit(1)).alias("n"))
        roots = new.select(F.col("low").alias("high")).distinct()
        open_ends = parents.filter("n > 1").select("high").union(roots.join(parents, "high", "left_semi"))
        links = new
        if open_ends.isEmpty():
            members = links.select(F.col("high").alias("node"), F.col("low").alias("component"))
            return stored(members.union(links.select("low", "low").distinct()), "components")
