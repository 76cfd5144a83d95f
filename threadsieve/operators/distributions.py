"""Label distributions, length statistics, class weights and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def distribution(df: DataFrame, column: str, within: list[str] | None = None) -> DataFrame:
    """``count`` and ``percentage`` of each value (null is one of them), in all
    or within the groups of ``within``."""
    within = within or []
    counts = df.groupBy(*within, column).agg(F.count("*").alias("count"))
    if not within:
        total = counts.select(F.sum("count").alias("n")).scalar()
        return counts.withColumn("percentage", F.col("count") / total)
    # The counts are few next to the rows; share by a window over them.
    w = Window.partitionBy(*within)
    return counts.withColumn("percentage", F.col("count") / F.sum("count").over(w))


def length_statistics(df: DataFrame, group: list[str], length: str = "text_length") -> DataFrame:
    """n, min, max, mean and linearly interpolated percentiles per group.

    Lengths repeat, so they are first counted per value; the exact percentile
    then works on (value, frequency) pairs.
    """
    freq = df.groupBy(*group, length).agg(F.count("*").alias("_f"))
    at = F.percentile(length, F.array(*[F.lit(p / 100) for p in PERCENTS]), F.col("_f"))
    return (
        freq.groupBy(*group)
        .agg(
            F.sum("_f").alias("n"), F.min(length).alias("min"), F.max(length).alias("max"),
            F.sum(F.col(length) * F.col("_f")).alias("_sum"), at.alias("_at"),
        )
        .select(
            *group, "n", "min", "max", (F.col("_sum") / F.col("n")).alias("mean"),
            *[F.get("_at", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTS)],
        )
    )


def quantile_bins(df: DataFrame, value: str, target: str, bins: int) -> DataFrame:
    """Mean target per quantile bin of ``value``: right-closed bins, the lowest
    edge included, equal edges merged."""
    freq = df.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.count("*").alias("_f"), F.sum(target).alias("_t"), F.count(target).alias("_c")
    )
    probs = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = freq.agg(F.array_distinct(F.percentile(value, probs, F.col("_f"))).alias("e")).select("e").scalar()
    below = F.size(F.filter(F.col("_edges"), lambda e: e < F.col(value)))
    return (
        freq.withColumn("_edges", edges)
        .withColumn("bin", F.greatest(below, F.lit(1)))
        .groupBy("bin")
        .agg(
            F.first(F.get("_edges", F.col("bin") - 1)).alias("low"),
            F.first(F.get("_edges", F.col("bin"))).alias("high"),
            F.sum("_f").alias("n"), (F.sum("_t") / F.sum("_c")).alias("mean_target"),
        )
    )


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Balanced class weights n / (k * n_c), and the positive/negative ratio of them."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per class
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    weighted = counts.withColumn("weight", weight)
    positive = F.max(F.when(F.col(target) == 1, F.col("weight"))).over(everything)
    negative = F.max(F.when(F.col(target) == 0, F.col("weight"))).over(everything)
    return weighted.withColumn("scale_pos_weight", positive / negative)


def profile(df: DataFrame, columns: list[str], exact: bool = False, categorical_limit: int = 20) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, range, and
    whether it is unique or categorical.

    One scan with mergeable sketches; ``exact`` replaces the distinct count by a
    count per column, for narrow columns.
    """
    types = dict(df.dtypes)
    distinct = F.count_distinct if exact else F.approx_count_distinct

    def measures(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.count("*").alias("n"),
            F.count_if(F.col(c).isNull()).alias("nulls"), distinct(F.col(c)).alias("distinct"),
            F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
        )

    if exact:
        # Several distinct counts in one aggregate would multiply every row.
        parts = [df.agg(measures(c).alias("m")).select("m.*") for c in columns]
        table = reduce(DataFrame.unionByName, parts)
    else:
        table = df.agg(F.array(*[measures(c) for c in columns]).alias("m")).select(F.inline("m"))
    return table.withColumns({
        "is_unique": F.when((F.col("distinct") == F.col("n")), 1).otherwise(0),
        "is_categorical": F.when(F.col("distinct") <= categorical_limit, 1).otherwise(0),
    })


def exact_profile(df: DataFrame, columns: list[str] | None = None, categorical_limit: int = 20) -> DataFrame:
    """The exact form of ``profile`` for all columns from one scan and one shuffle of distinct values.

    Every row becomes one row per column with the digest of its value. Equal values meet in the map-side sums, so a frequent one ships
    one row per task, and the distinct ones of a column are spread over all tasks by their digest. Numbers are
    ordered as numbers, all other types as they are written. A table without rows has no profile.
    """
    types = dict(df.dtypes)
    columns = columns or df.columns

    def cell(c: str) -> Column:
        kind, value = types[c], F.col(f"`{c}`")
        whole = kind in ("tinyint", "smallint", "int", "bigint", "boolean")
        broken = kind in ("float", "double") or kind.startswith("decimal")
        text = value.cast("string") if not kind.startswith(("array", "map", "struct")) else F.to_json(value)
        return F.struct(
            F.lit(c).alias("column"), F.lit(kind).alias("type"), F.md5(text).alias("digest"),
            F.when(value.isNotNull(), F.struct(
                (value.cast("long") if whole else F.lit(None).cast("long")).alias("l"),
                (value.cast("double") if broken else F.lit(None).cast("double")).alias("d"), text.alias("text"))).alias("value"))

    cells = df.select(F.explode(F.array(*[cell(c) for c in columns])).alias("c")).select("c.*")
    values = cells.groupBy("column", "type", "digest").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    table = values.groupBy("column", "type").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("digest").alias("distinct"), F.min("value").getField("text").alias("min"), F.max("value").getField("text").alias("max"))
    return table.withColumns({
        "is_unique": F.when((F.col("distinct") == F.col("n")), 1).otherwise(0),
        "is_categorical": F.when(F.col("distinct") <= categorical_limit, 1).otherwise(0),
    })
