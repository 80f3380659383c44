"""A cleaning pipeline over `documents`: stages in order, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltcellar.llm import decontaminate, jaccard, linededup, mixing, quality
from saltcellar.llm.shared import stored, table

LEAST_LEFT = 0.2  # 1 less the similarity from which on documents are near copies
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go. So do documents with less than `LEAST_LEFT` of their characters left: as much of them stands in earlier
    documents as makes a near copy, and what is left would pass the next stage as a text of its own. Null text counts as empty;
    documents without repeated lines stay as they are."""
    out = linededup.dedup_lines(docs.select(*COLUMNS, F.char_length(F.coalesce("text", F.lit(""))).alias("whole")))
    changed = F.col("n_exact") + F.col("n_near") > 0
    left = F.char_length(F.trim("text"))
    out = out.filter(~changed | ((left > 0) & (left >= LEAST_LEFT * F.col("whole"))))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that are taken, with the number of copies that brings their source to its target."""
    mixed = mixing.mix(docs, keep=COLUMNS)
    return mixed.filter("copies > 0").select(*COLUMNS, "size", "copies", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", lines_stage),
    ("similar", similar_stage),
    ("decontaminate", benchmark_stage),
    ("mix", mix_stage),
]

# A trained network decides in the first stage, which SQL can't express: the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written under the shared folder and is the next one's input.

    Stages keep the five columns of `COLUMNS`; further ones of the table are left out. Rows with null keys or texts pass like others
    (null text is empty text), repeated rows are copies of each other, ties fall as each operator states, an empty table stays empty.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
