"""Summaries of run tables: best run, repeated results, latency, perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_run(df: DataFrame, display: list[str], metric: str = "recall", model: str = "model", order: str = "run") -> DataFrame:
    """The run with the highest metric per model (the first on a tie), in a
    fixed display order; models not on the list come last."""
    w = Window.partitionBy(model).orderBy(F.col(metric).desc(), F.col(order))
    place = F.array_position(F.array(*[F.lit(m) for m in display]), F.col(model))
    return (
        df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
        .withColumn("place", F.when(place > 0, place).otherwise(len(display) + 1))
    )


def first_per_value(df: DataFrame, value: str, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Drop rows repeating a value, keeping the first in the given order."""
    w = Window.partitionBy(*(within or []), value).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def latency_summary(df: DataFrame, group: list[str], duration: str = "duration") -> DataFrame:
    """Items, total duration, throughput n/duration and latency duration/n."""
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(duration).alias("duration"),
        F.try_divide(F.count("*"), F.sum(duration)).alias("throughput"),
        (F.sum(duration) / F.count("*")).alias("latency"),
    )


def perplexity(df: DataFrame, group: list[str], loss: str = "loss") -> DataFrame:
    """exp(mean loss); an overflow is infinity."""
    mean = F.avg(loss)
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), mean.alias("mean_loss"), F.exp(mean).alias("perplexity")
    )


def early_stop(epochs: DataFrame, patience: int, metric: str = "perplexity", epoch: str = "epoch", group: list[str] | None = None) -> DataFrame:
    """Best and last epoch of a run that stops once ``patience`` epochs pass
    without a strictly lower metric.

    ``epochs`` has one row per epoch (and group), as training writes it.
    """
    group = group or []
    ordered = Window.partitionBy(*group).orderBy(epoch)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(metric).over(earlier)
    better = best.isNull() | (F.col(metric) < best)
    marked = (
        epochs.withColumn("_best", F.when(better, F.col(epoch)))
        .withColumn("_best", F.max("_best").over(upto))
        .withColumn("_stop", F.when(F.lit(patience > 0) & (F.col(epoch) - F.col("_best") > patience), F.col(epoch)))
        .withColumn("_stopped", F.min("_stop").over(earlier))
        .where(F.col("_stopped").isNull())
    )
    return marked.groupBy(*group).agg(
        F.max("_best").alias("best_epoch"), F.min(metric).alias("best_metric"), F.max(epoch).alias("last_epoch"),
    )
