"""Chat formatting of reply trees: paths by self-joins, branches by score, one conversation per chosen path."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltcellar.llm.shared import stored, stored_and_counted, text_of

# The template's marks, and what stands for control strings inside a text. "~" comes first when escaping and last
# when read back, so every text comes back as it was.
BEGIN, END = "<|im_start|>", "<|im_end|>"
ESCAPES = (
    ("~", "~0"), ("<|", "~1"), ("[INST]", "~2"), ("[/INST]", "~3"), ("<s>", "~4"), ("</s>", "~5"), ("<<SYS>>", "~6"), ("<</SYS>>", "~7"),
)
LINE_END_IN_ROLE = ("\n", "~n")
LEARNED_ROLE = "assistant"
_TURN = re.compile(re.escape(BEGIN) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escaped(text: Column) -> Column:
    for plain, mark in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: str) -> str:
    for plain, mark in reversed(ESCAPES):
        text = text.replace(mark, plain)
    return text


def threads(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A table of turns as reply trees without forks: rows (tree, node, parent, score, role, text).

    Rows of a conversation follow each other by turn (null first), then role and text; each replies to the one before.
    A null conversation id is one conversation of its own.
    """
    order = Window.partitionBy("tree").orderBy("at", "role", "text")
    rows = conversations.select(
        F.struct(F.col(conv).alias("id")).alias("tree"), F.col(turn).alias("at"), text_of("role").alias("role"), text_of("text").alias("text")
    )
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def branches(nodes: DataFrame, most: int | None = 1) -> DataFrame:
    """Chosen root-to-leaf paths as rows (tree, leaf, rank, node, depth) from nodes (tree, node, parent, score).

    Every round joins the nodes with themselves and doubles how far each one sees up (a chain of n replies takes log2 n
    rounds), adding up scores and steps on the way. Leaves are ranked in their tree by mean score along the path (null score: 0),
    then node; the best `most` are kept (None: all). The same jumps, taken back from the widest, list the nodes of a path, each
    once. A node whose parent is not in the table starts a tree of its own; nodes in a circle have no root and are left
    out; node ids are unique in a tree.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    base = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("steps"))
    now = base.join(known, ["tree", "parent"], "left")
    now = now.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), "total", "steps")
    counts = {"nodes": F.count(F.lit(1)), "open": F.count_if(F.col("up").isNotNull())}
    now, counted = stored_and_counted(now, "tree-jumps", **counts)
    jumps = []
    rounds = max(1, counted["nodes"].bit_length() + 1)
    while counted["open"] and len(jumps) < rounds:
        open_ends = now.filter("up IS NOT NULL")
        jumps.append(open_ends.select("tree", "node", "up"))
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        # Only nodes that do not see a root yet look further; every `up` is a node of the table.
        seen = open_ends.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps")
        )
        now, counted = stored_and_counted(now.filter("up IS NULL").union(seen), "tree-jumps", **counts)
    replied = jumps[0].select("tree", F.col("up").alias("node")).distinct() if jumps else None
    leaves = now.filter("up IS NULL")
    leaves = leaves.join(replied, ["tree", "node"], "left_anti") if jumps else leaves
    best = Window.partitionBy("tree").orderBy((F.col("total") / F.col("steps")).desc(), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    leaves = leaves.filter(F.col("rank") <= most) if most is not None else leaves
    path = leaves.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("steps").alias("depth"))
    for level in range(len(jumps) - 1, -1, -1):
        up = jumps[level]
        above = path.join(up, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << level)).alias("depth"))
        path = stored(path.union(above), "tree-paths")
    return path


def format_trees(nodes: DataFrame, most: int | None = 1) -> DataFrame:
    """One row per chosen path: (tree, leaf, rank, formatted, loss), loss being spans (start, end) of code points.

    A turn is a begin mark, the role, a line feed, the text and an end mark; control strings inside roles and texts are
    escaped reversibly. The loss lies on the texts of the assistant. Null roles and texts are empty.
    """
    nodes = stored(nodes, "tree-nodes")
    path = branches(nodes.select("tree", "node", "parent", "score"), most)
    role = F.replace(escaped(text_of("role")), F.lit(LINE_END_IN_ROLE[0]), F.lit(LINE_END_IN_ROLE[1]))
    turns = path.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.select(
        "tree", "leaf", "rank", "depth", (text_of("role") == LEARNED_ROLE).alias("learned"),
        F.concat(F.lit(BEGIN), role, F.lit("\n")).alias("head"), escaped(text_of("text")).alias("body"),
    )
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    turns = turns.withColumn("start", start)
    span = F.when(F.col("learned"), F.struct(F.col("start"), (F.col("start") + F.char_length("body")).alias("end")))
    listed = turns.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("depth", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss")
    )
    return listed.select("tree", "leaf", "rank", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescaped(r.replace(LINE_END_IN_ROLE[1], LINE_END_IN_ROLE[0])), unescaped(t)) for r, t in _TURN.findall(formatted)]


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, formatted, starts, ends in zip(batch["conv_id"], batch["formatted"], batch["starts"], batch["ends"]):
                turns = read_back(formatted)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                learned = "".join(unescaped(formatted[a:b]) for a, b in zip(starts, ends))
                rows.append((conv, len(turns), _sha(whole), len(learned), _sha(learned), len(formatted)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = conversations.select(
        F.col("tree.id").alias("conv_id"), "formatted", F.col("loss.start").alias("starts"), F.col("loss.end").alias("ends")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInPandas(
        read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
