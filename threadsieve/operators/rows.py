"""Row-wise operators: filters, derived columns, labels, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header rules of a scoring request.
CALLER_RULE = r"^[0-9]{1,10}$"
USER_RULE = r"^[a-zA-Z]{1}[0-9]{3,10}$"
REQUEST_RULE = r"^[0-9a-zA-Z-]{1,60}$"
LABEL_TEXT = {1: "Complaint", 0: "Non-Complaint"}


def nonempty(df: DataFrame, column: str = "email") -> DataFrame:
    # A null length is not > 0 either; the column is evaluated once.
    return df.where(F.length(column) > 0)


def in_state(df: DataFrame, state: str = "closed") -> DataFrame:
    return df.where(F.col("state") == state)


def in_window(df: DataFrame, start: str, end: str, column: str = "time") -> DataFrame:
    """Both ends inclusive. A date stands for its midnight, so the rest of the
    last day is left out."""
    return df.where(F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def exclude_months(df: DataFrame, months: list[tuple[int, int]], column: str = "time") -> DataFrame:
    """Leave out the given (year, month) pairs; rows without a time stay."""
    index = F.year(column) * 12 + F.month(column)
    return df.where(F.coalesce(~index.isin([y * 12 + m for y, m in months]), F.lit(True)))


def with_calendar(df: DataFrame, column: str = "time") -> DataFrame:
    return df.withColumns({
        "year": F.year(column), "month": F.month(column), "day": F.dayofmonth(column),
    })


def complaint(feedback_counts: bool = False) -> Column:
    """1 for a complaint (or, optionally, feedback); missing labels count as 0."""
    hit = F.col("is_complaint").eqNullSafe("Y")
    if feedback_counts:
        hit = hit | F.col("is_feedback").eqNullSafe("Y")
    return F.when(hit, 1).otherwise(0)


def target_by_split() -> Column:
    """Feedback counts while training and validating, not when testing."""
    return F.when(F.col("data_type") == "test", complaint()).otherwise(complaint(feedback_counts=True))


def underscore_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def apply_threshold(df: DataFrame, prob: str = "prob", threshold: Column | float | None = 0.5) -> DataFrame:
    """Label strictly above the threshold, with its text and both probabilities; without a threshold no label."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    label = F.when(F.col(prob) > limit, 1).when(limit.isNotNull(), 0)
    return df.withColumns({
        "predicted_label": label,
        "pred_response": F.when(label == 1, LABEL_TEXT[1]).when(label == 0, LABEL_TEXT[0]),
        "pred_1": F.col(prob),
        "pred_0": 1 - F.col(prob),
    })


def length_bucket(length: Column, limit: int = 512) -> Column:
    return F.when(length <= limit, f"<={limit}").when(length > limit, f">{limit}")


def error_slice(df: DataFrame, kind: str, target: str = "target", predicted: str = "predicted_label") -> DataFrame:
    """``false_positive`` or ``false_negative`` rows."""
    want = {"false_positive": (0, 1), "false_negative": (1, 0)}[kind]
    return df.where((F.col(target) == want[0]) & (F.col(predicted) == want[1]))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons``, the names of the rules a row breaks (empty: accepted).

    A rule that yields null counts as broken.
    """
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def request_rules() -> dict[str, Column]:
    """Rules for a scoring request with header columns and a typed body."""
    return {
        "caller_id": F.col("caller_id").rlike(CALLER_RULE),
        "user_id": F.col("user_id").rlike(USER_RULE),
        "request_id": F.col("request_id").rlike(REQUEST_RULE),
        "body": F.col("snapshot_id").isNotNull() & F.col("email").isNotNull() & F.col("time").isNotNull(),
    }


def route_empty(df: DataFrame, scorer, text: str = "preprocessed_email") -> DataFrame:
    """Rows left without text get probability 0; only the others are scored.

    ``scorer`` maps a DataFrame to itself plus ``prob_pred``.
    """
    has_text = F.coalesce(F.length(text) > 0, F.lit(False))
    empty = df.where(~has_text).withColumn("prob_pred", F.lit(0.0))
    return scorer(df.where(has_text)).unionByName(empty, allowMissingColumns=True)
