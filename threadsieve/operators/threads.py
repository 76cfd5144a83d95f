"""One message per conversation thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_per_key(df: DataFrame, key: str, order: list[Column], keep_null_keys: bool) -> DataFrame:
    # Filtering on row_number = 1 lets Spark prune each thread inside every
    # map task (WindowGroupLimit) before the shuffle, so a hot thread ships one
    # row per task.
    w = Window.partitionBy(key).orderBy(*order)
    keyed = df.where(F.col(key).isNotNull())
    first = keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return first.unionByName(df.where(F.col(key).isNull())) if keep_null_keys else first


def latest_per_thread(
    df: DataFrame, key: str = "thread_id", time: str = "time", row_id: str = "snapshot_id",
    keep_null_keys: bool = False,
) -> DataFrame:
    """The newest message of each thread; equal times go to the lowest id.

    Rows without a thread are dropped unless ``keep_null_keys``.
    """
    return _first_per_key(df, key, [F.col(time).desc(), F.col(row_id)], keep_null_keys)


def complaint_first_per_thread(
    df: DataFrame, label: str = "is_complaint", key: str = "thread_id", time: str = "time",
    row_id: str = "snapshot_id", keep_null_keys: bool = False,
) -> DataFrame:
    """A complaint if the thread has one, else the newest labelled, else the newest."""
    order = [F.col(label).desc_nulls_last(), F.col(time).desc(), F.col(row_id)]
    return _first_per_key(df, key, order, keep_null_keys)
