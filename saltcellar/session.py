"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BROADCAST_ROWS = 400_000
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def open_session(app: str = "saltcellar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Business days and clock hours are defined in UTC, whatever the host zone is. Folder names are read as texts: a day is no number."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    configured = spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="saltcellar-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{_shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a scratch table deleted when the driver ends; results that are read later belong elsewhere."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of an execution inside go when it ends, not when the driver next collects its garbage.

    For executions whose result is stored. Frames made inside would run their plan again if they were executed twice.
    """
    was = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if was is None else spark.conf.set(CLEANUP_CONF, was)


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage so that later readers do not run its plan again.

    Used where one aggregated table feeds several passes (quantiles, totals, the rows).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a frame made in here: the setting is read when a frame is made


def at_hand(df: DataFrame) -> DataFrame:
    """A settled frame for joins: sent to all tasks while it is small, by its counted rows."""
    kept = settle(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as a scratch table that goes when the driver ends; each reader then scans its own columns, compressed."""
    path = scratch_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
