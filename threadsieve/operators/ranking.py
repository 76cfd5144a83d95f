"""Exact ranks, cuts and running totals without a single-task window.

``row_number`` over a whole class sends the class to one task. The three
helpers below reach the same answers through counts per bucket: windows only
ever run over a bounded number of buckets, or over the rows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a few narrow columns that one task may sort.
TASK_ROWS = 1_000_000


def rank_cuts(
    rows: DataFrame,
    wanted: DataFrame,
    group: list[str],
    levels: list[str],
    order: list[str],
    keep: list[str],
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Find, per group, the rows standing at given ranks.

    ``wanted`` has the group columns and ``ks``, an array of 1-based ranks.
    ``levels`` and then ``order`` name columns of ``rows`` whose ascending
    lexicographic order is the ranking. Returns group columns, ``rank`` and the
    ``keep`` columns of the row at that rank: one row per wanted rank.

    Each level counts rows per bucket (partial aggregation, nothing else is
    shuffled) and keeps the bucket each rank falls into. It ends once every such
    bucket has at most ``task_rows`` rows; only those are ranked row by row.
    The search runs when called. Between the levels, and as the result, only one
    row per wanted rank is held, as a local table.
    """
    spark = rows.sparkSession
    state = wanted.select(
        *group,
        F.transform("ks", lambda k: F.struct(k.cast("long").alias("rank"), k.cast("long").alias("left"))).alias("ks"),
    )
    prefix, rest = list(group), list(levels)
    while rest:
        level = rest.pop(0)
        counted = (
            rows.join(F.broadcast(state), prefix)
            .groupBy(*prefix, "ks", level)
            .agg(F.count("*").alias("_n"))
        )
        earlier = (
            Window.partitionBy(*prefix).orderBy(level)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        found = (
            counted
            .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
            .withColumn("ks", F.filter(
                "ks",
                lambda k: (k["left"] > F.col("_before")) & (k["left"] <= F.col("_before") + F.col("_n")),
            ))
            .where(F.size("ks") > 0)
            .withColumn("ks", F.transform(
                "ks",
                lambda k: F.struct(k["rank"].alias("rank"), (k["left"] - F.col("_before")).alias("left")),
            ))
            .select(*prefix, level, "ks", "_n")
        )
        buckets = found.collect()
        state = spark.createDataFrame(buckets, found.schema).drop("_n")
        prefix = prefix + [level]
        if max((b["_n"] for b in buckets), default=0) <= task_rows:
            break
    ranked = Window.partitionBy(*prefix).orderBy(*rest, *order)
    columns = [c for c in keep if c not in group]
    cuts = (
        rows.join(F.broadcast(state), prefix)
        .withColumn("_rn", F.row_number().over(ranked))
        .withColumn("_hit", F.filter("ks", lambda k: k["left"] == F.col("_rn")))
        .where(F.size("_hit") > 0)
        .select(*group, F.explode("_hit").alias("_hit"), *columns)
        .select(*group, F.col("_hit.rank").alias("rank"), *columns)
    )
    return spark.createDataFrame(cuts.collect(), cuts.schema)


def positions(
    rows: DataFrame, group: list[str], level: str, order: list[Column], name: str = "position"
) -> DataFrame:
    """Number the rows of each group 1..n in the order (level, order).

    ``level`` must split a group into many even buckets (a digest prefix). Rows
    are shuffled once by (group, level); the offset of each bucket comes from a
    table of counts with at most one row per bucket.
    """
    counted = rows.groupBy(*group, level).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        *group, level, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, level).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), [*group, level])
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_offset", "_rn")
    )


def running_totals(
    counts: DataFrame, group: list[str], levels: list[str], order: str, sums: list[str]
) -> DataFrame:
    """Totals of ``sums`` over all rows standing before each row of its group.

    ``counts`` has one row per (group, levels, order). Adds ``<sum>_before``.
    Offsets are rolled up level by level, so no window is longer than the
    number of values of one level.
    """
    if not levels:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *[
            F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"{s}_before") for s in sums
        ])
    *outer, last = levels
    rolled = counts.groupBy(*group, *levels).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = running_totals(rolled, group, outer, last, sums).select(
        *group, *levels, *[F.col(f"{s}_before").alias(f"_{s}_outer") for s in sums]
    )
    w = (
        Window.partitionBy(*group, *levels).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = counts.select("*", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_{s}_inner") for s in sums])
    return inner.join(offsets, [*group, *levels]).select(
        *counts.columns,
        *[(F.col(f"_{s}_inner") + F.col(f"_{s}_outer")).alias(f"{s}_before") for s in sums],
    )
