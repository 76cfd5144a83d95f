"""From raw messages to a labelled, balanced, cleaned corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.functions import text as tx
from threadsieve.functions.lexicons import BOILERPLATE, STOP_WORDS
from threadsieve.operators import distributions, rows, sampling, splits, threads
from threadsieve.session import store

DEDUP = {
    None: lambda df: df,
    "latest": threads.latest_per_thread,
    "target": threads.complaint_first_per_thread,
}


def select_messages(df: DataFrame, start: str, end: str, state: str = "closed", dedup: str | None = None) -> DataFrame:
    """Non-empty messages of a state and time window, one per thread if asked.

    A deduplicated selection is stored: splitting and sampling read its narrow
    columns several times.
    """
    kept = rows.in_window(rows.in_state(rows.nonempty(df), state), start, end)
    return store(DEDUP[dedup](kept), "messages") if dedup else kept


def split_and_label(df: DataFrame, test: str, feedback_counts: bool = True, val_share: float = 0.2) -> DataFrame:
    """Months before the test month are train and val (newest share per class).

    The class decides the split, so the label comes first.
    """
    split = splits.split_by_month(df, test)
    labelled = split.withColumn(
        "target", rows.target_by_split() if feedback_counts else rows.complaint()
    )
    seen = splits.split_newest(labelled.where("data_type = 'train'").drop("data_type"), val_share)
    return seen.unionByName(labelled.where("data_type = 'test'"))


def clean_texts(
    df: DataFrame, phrases: list[str] = BOILERPLATE, separator: str = "\n\n",
    stop_words: list[str] | None = STOP_WORDS,
) -> DataFrame:
    """Quotes, repeated paragraphs, boilerplate sentences, then the cleaning rules.

    All steps are expressions on one column: a single pass over the texts.
    """
    text = tx.normalise_quotes(F.col("email"))
    text = tx.remove_phrases(tx.dedup_paragraphs(text, separator), phrases)
    return df.withColumn("preprocessed_email", tx.clean(text, stop_words))


def balance(df: DataFrame, ratio: int | None, seed: int = 101, val_ratio: int | None | str = "same") -> DataFrame:
    """Undersample the negatives of train by ``ratio`` and those of val by ``val_ratio``, by default the same.

    A split whose ratio is None stays as it is, and so do the test rows.
    """
    ratios = {"train": ratio, "val": ratio if val_ratio == "same" else val_ratio, "test": None}
    parts = []
    for kind, wanted in ratios.items():
        own = df.where(F.col("data_type") == kind)
        parts.append(own.withColumn("draw", F.lit(None).cast("long")) if wanted is None else sampling.undersample_ratio(own, wanted, seed))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def monthly_labels(df: DataFrame, start: str, end: str) -> DataFrame:
    """Label distribution per month of closed messages, the newest per thread,
    that still hold words after cleaning."""
    kept = rows.in_window(rows.in_state(rows.nonempty(df)), start, end)
    kept = clean_texts(threads.latest_per_thread(kept), separator="\n")
    kept = rows.with_calendar(rows.nonempty(kept, "preprocessed_email"))
    return distributions.distribution(
        kept.withColumn("target", rows.complaint()), "target", ["year", "month"]
    )
