"""Every registered query with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saltcellar.functions.columns import portable
from saltcellar.plans import checks_ingest, checks_menu, checks_questions, checks_sales, checks_scoped, checks_social, checks_upkeep
from saltcellar.plans.oracle_tables import with_tables
from saltcellar.plans.oracle_views import VIEWS
from saltcellar.plans.samples import Samples

SECTIONS = [checks_ingest, checks_sales, checks_menu, checks_questions, checks_social, checks_upkeep, checks_scoped]


def _runner(build: Callable[[Samples], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: portable(build(Samples(spark, folder)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for section in SECTIONS for name, build in section.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    blocks = dict(VIEWS)
    for section in SECTIONS:
        blocks.update(getattr(section, "BLOCKS", {}))
    return {name: with_tables(sql, blocks) for section in SECTIONS for name, sql in section.SQL.items()}
