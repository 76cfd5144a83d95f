"""Session defaults, shared scratch space and size checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side table is hinted for broadcast only after it was counted below this.
BROADCAST_ROW_LIMIT, BROADCAST_BYTES = 200_000, 32 << 20
# Spark's switch to delete the shuffle files of an action when it ends, not when the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "threadsieve", **conf) -> SparkSession:
    """Session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    A session without that setting gets one below its warehouse folder when it
    runs in a single process; on a cluster it is an error, since a folder
    that executors do not share would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str, replace: bool = True) -> Iterator[None]:
    """A setting of the session for the actions inside; without ``replace`` one that is set stays."""
    before = spark.conf.get(key, None)
    if before is None or replace:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Split a scan of few input splits before heavy per-row work.

    A large table already arrives in more splits than there are cores and is
    returned untouched; only a short scan pays for a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


def hint_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when a bounded look proves it small, in rows and in bytes written as JSON, else leave the
    join strategy to the optimizer (shuffle join, AQE skew handling)."""
    seen = df.limit(limit + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if seen[0] <= limit and (seen[1] or 0) <= size else df


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    For results that several branches of a plan read: the work is done once, a
    lost executor does not repeat it, and later scans read only the columns they
    need. The shuffles that made it are deleted: nothing reads them again.
    """
    path = scratch_path(df.sparkSession, purpose)
    with setting(df.sparkSession, SHUFFLES_GO, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
