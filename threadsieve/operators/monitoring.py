"""Calibrate on one period, watch the next; compare models day by day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.operators.evaluation import MIN_RECALL, _ratio, counts_above, threshold_for_recall
from threadsieve.session import hint_if_small, store

BASELINE = "lexicon search"


def join_predictions(features: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the message keys. Null keys do not match."""
    return features.join(predictions, keys)


def align_models(scored: dict[str, DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """One row per message scored by every model; ``columns`` get the model's suffix."""
    renamed = [
        df.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in columns]) for name, df in scored.items()
    ]
    return reduce(lambda a, b: a.join(b, keys), renamed)


def calibrate_and_apply(
    df: DataFrame, period: str, min_recall: float = MIN_RECALL, prob: str = "prob", target: str = "target",
    by: list[str] | None = None,
) -> DataFrame:
    """Give every row the threshold calibrated on the period before its own.

    ``period`` is an integer column (months counted from a start, say). Rows
    without a label do not take part in the calibration. Rows of the first
    period have no threshold and are left out.
    """
    by = by or []
    tuned = threshold_for_recall(df.where(F.col(target).isNotNull()), min_recall, prob, target, [*by, period])
    ready = tuned.select(*by, (F.col(period) + 1).alias(period), "best_threshold")
    # One row per period; of groups there may be many, so these are counted first.
    side = hint_if_small(store(ready, "thresholds")) if by else F.broadcast(ready)
    return df.join(side, [*by, period])


def compare_models(df: DataFrame, models: dict[str, Column], target: str = "target", by: list[str] | None = None) -> DataFrame:
    """n, positives, tp, fp, fn of every model and of flagging everything.

    ``models`` maps a name to a boolean prediction. All models are counted in one
    aggregation and turned into rows afterwards, so rows are not repeated per
    model.
    """
    by = by or []
    predictions = {BASELINE: F.lit(True), **models}
    aggregates = []
    for i, predicted in enumerate(predictions.values()):
        named = counts_above(F.col(target), predicted)
        aggregates.append(F.struct(*[c.alias(n) for n, c in named.items()]).alias(f"_m{i}"))
    wide = df.groupBy(*by).agg(*aggregates)
    lines = [
        F.struct(F.lit(name).alias("model"), *[
            F.col(f"_m{i}.{c}").alias(c) for c in ("n", "positives", "tp", "fp", "fn")
        ])
        for i, name in enumerate(predictions)
    ]
    return wide.select(*by, F.inline(F.array(*lines)))


def month_comparison(df: DataFrame, models: dict[str, Column], target: str = "target") -> DataFrame:
    """Precision, recall, false positives and false negatives per model."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return compare_models(df, models, target).select(
        "model", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), "fp", "fn",
    )


def workload_reduction(df: DataFrame, models: dict[str, Column], target: str = "target") -> DataFrame:
    """Share of the messages a model spares the reviewers."""
    return compare_models(df, models, target).select(
        "model", "n", (F.col("tp") + F.col("fp")).alias("predicted"),
        (1 - F.try_divide(F.col("tp") + F.col("fp"), F.col("n"))).alias("reduction"),
    )


def daily_rates(daily: DataFrame, by: list[str]) -> DataFrame:
    """Precision and recall per day; a day without positives has recall 1, precision 0."""
    some = F.col("positives") > 0
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return daily.select(
        *by, "model", F.when(some, _ratio(tp, tp + fp)).otherwise(0.0).alias("precision"),
        F.when(some, _ratio(tp, tp + fn)).otherwise(1.0).alias("recall"),
    )


def daily_errors(daily: DataFrame, by: list[str]) -> DataFrame:
    """False positives and negatives per day; 0 on days without positives."""
    some = F.col("positives") > 0
    return daily.select(
        *by, "model", F.when(some, F.col("fp")).otherwise(0).alias("fp"),
        F.when(some, F.col("fn")).otherwise(0).alias("fn"),
    )


def false_positive_reduction(errors: DataFrame, by: list[str]) -> DataFrame:
    """Percentage of the baseline's false positives a model avoids; null if it has none."""
    base = F.max(F.when(F.col("model") == BASELINE, F.col("fp")))
    models = F.collect_list(F.when(F.col("model") != BASELINE, F.struct("model", "fp")))
    return (
        errors.groupBy(*by).agg(base.alias("baseline_fp"), models.alias("_m"))
        .select(*by, "baseline_fp", F.inline("_m"))
        .withColumn("reduction_pct", F.when(
            F.col("baseline_fp") != 0, (F.col("baseline_fp") - F.col("fp")) / F.col("baseline_fp") * 100
        ))
    )


def slice_distributions(
    df: DataFrame, columns: list[str], target: str = "target", predicted: str = "predicted_label"
) -> DataFrame:
    """Distribution of each column over all rows and over the error slices.

    Rows are counted once per combination of class, prediction and the columns;
    slices and measures are made from those few counts.
    """
    counts = df.groupBy(target, predicted, *columns).agg(F.count("*").alias("_n"))
    t, p = F.col(target), F.col(predicted)
    slices = F.array_compact(F.array(
        F.lit("all"),
        F.when((t == 0) & (p == 1), "false_positive").when((t == 1) & (p == 0), "false_negative"),
    ))
    measures = F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    lines = counts.select(F.explode(slices).alias("slice"), measures.alias("_m"), "_n").select(
        "slice", F.inline("_m"), "_n"
    )
    summed = lines.groupBy("slice", "measure", "value").agg(F.sum("_n").alias("count"))
    w = Window.partitionBy("slice", "measure")
    return summed.withColumn("percentage", F.col("count") / F.sum("count").over(w))
