"""Train / validation / test splits and balanced sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadsieve.functions.keys import (
    digest, digest_level, seeded_unit, time_levels_asc, time_levels_desc,
)
from threadsieve.operators.ranking import rank_cuts


def month_start(token: str) -> str:
    """First day of the month named by an ``MM_yy`` token."""
    month, year = token.split("_")
    if not 1 <= int(month) <= 12:
        raise ValueError(f"not a month token: {token!r}")
    return f"20{int(year):02d}-{int(month):02d}-01"


def split_by_month(df: DataFrame, test: str, val: str | None = None, column: str = "time") -> DataFrame:
    """``data_type`` by calendar month: before is train, the named months are
    val and test, later rows are dropped."""
    month = F.trunc(F.to_date(column), "month")
    test_month = F.lit(month_start(test)).cast("date")
    kind = F.when(month == test_month, "test")
    if val:
        val_month = F.lit(month_start(val)).cast("date")
        kind = kind.when(month == val_month, "val").when(month < val_month, "train")
    else:
        kind = kind.when(month < test_month, "train")
    return df.withColumn("data_type", kind).where(F.col("data_type").isNotNull())


def _share_per_class(rows: DataFrame, target: str, share: float) -> DataFrame:
    """Rank of the last validation row of each class: floor(share * class size)."""
    size = rows.groupBy(target).agg(F.count("*").alias("_n"))
    k = F.floor(F.lit(share) * F.col("_n")).cast("long")
    return size.select(target, F.array(k).alias("ks")).where(F.element_at("ks", 1) > 0)


def _known_time(df: DataFrame, time: str) -> Column:
    """The time, or a day before all others for a null: such rows rank as the oldest."""
    return F.coalesce(F.col(time), F.lit("0002-01-01 00:00:00").cast(df.schema[time].dataType))


def split_newest(
    df: DataFrame, share: float = 0.2, target: str = "target", time: str = "time",
    row_id: str = "snapshot_id",
) -> DataFrame:
    """Per class, the newest ``floor(share * n)`` rows become val, the rest train.

    Only the time and id of the last validation row of each class are looked
    up; the wide rows are then labelled in place, without a shuffle. Equal
    times are ordered by the digest of the id.
    """
    when = _known_time(df, time)
    d, sec, micro = time_levels_desc(when)
    rows = df.select(
        F.col(target), when.alias("_time"), digest(F.col(row_id)).alias("_digest"),
        d.alias("_l1"), sec.alias("_l2"), micro.alias("_l3"),
    ).withColumn("_l4", digest_level(F.col("_digest")))
    cuts = rank_cuts(
        rows, _share_per_class(rows, target, share), [target], ["_l1", "_l2", "_l3", "_l4"],
        ["_digest"], ["_time", "_digest"],
    ).drop("rank")
    in_val = (when > F.col("_time")) | (
        (when == F.col("_time")) & (digest(F.col(row_id)) <= F.col("_digest"))
    )
    return (
        df.join(F.broadcast(cuts), target, "left")
        .withColumn("data_type", F.when(in_val, "val").otherwise("train"))
        .select(*df.columns, "data_type")
    )


def split_shuffled(
    df: DataFrame, share: float = 0.2, seed: int = 101, target: str = "target",
    row_id: str = "snapshot_id",
) -> DataFrame:
    """Per class, ``floor(share * n)`` rows in seeded digest order become val."""
    rows = df.select(F.col(target), digest(F.col(row_id), seed).alias("_digest")).withColumn(
        "_l1", digest_level(F.col("_digest"))
    )
    cuts = rank_cuts(
        rows, _share_per_class(rows, target, share), [target], ["_l1"], ["_digest"], ["_digest"]
    ).drop("rank")
    in_val = digest(F.col(row_id), seed) <= F.col("_digest")
    return (
        df.join(F.broadcast(cuts), target, "left")
        .withColumn("data_type", F.when(in_val, "val").otherwise("train"))
        .select(*df.columns, "data_type")
    )


def split_random(
    df: DataFrame, share: float = 0.2, seed: int = 101, row_id: str = "snapshot_id", held: str = "test"
) -> DataFrame:
    """Each row is held out with probability ``share``: one pass, no shuffle."""
    kind = F.when(seeded_unit(F.col(row_id), seed) < share, held).otherwise("train")
    return df.withColumn("data_type", kind)


def shard(df: DataFrame, n: int, time: str = "time", row_id: str = "snapshot_id") -> DataFrame:
    """Contiguous shards 0..n-1 in time order; the first ``rows % n`` are one larger."""
    when = _known_time(df, time)
    d, sec, micro = time_levels_asc(when)
    rows = df.select(
        F.lit(0).alias("_all"), when.alias("_time"), digest(F.col(row_id)).alias("_digest"),
        d.alias("_l1"), sec.alias("_l2"), micro.alias("_l3"),
    ).withColumn("_l4", digest_level(F.col("_digest")))
    total = rows.groupBy("_all").agg(F.count("*").alias("_n"))
    base, extra = F.expr(f"_n div {n}"), F.col("_n") % n
    ends = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: j * base + F.least(j.cast("long"), extra))
    wanted = total.select("_all", F.array_distinct(F.filter(ends, lambda e: e > 0)).alias("ks"))
    cuts = rank_cuts(
        rows, wanted, ["_all"], ["_l1", "_l2", "_l3", "_l4"], ["_digest"], ["_time", "_digest"]
    )
    # The n last rows of the shards, as one small array.
    bounds = cuts.select(F.sort_array(F.collect_list(F.struct("_time", "_digest"))).alias("e")).scalar()

    def behind(c: Column) -> Column:
        return (c["_time"] < when) | ((c["_time"] == when) & (c["_digest"] < F.col("_d")))

    return (
        df.withColumns({"_ends": bounds, "_d": digest(F.col(row_id))})
        .withColumn("shard", F.size(F.filter("_ends", behind)))
        .select(*df.columns, "shard")
    )
