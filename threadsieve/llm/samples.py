"""Bounded labelled samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.llm.common import digest


def per_class(rows: DataFrame, label: str, n: int) -> DataFrame:
    """At most ``n`` rows of each label: those of the least hash of id and text, one of repeated rows.

    Ranks are taken over distinct hashes alone. The chosen keys, at most ``n`` per label, then pick the texts.
    """
    keyed = rows.withColumn("_key", F.xxhash64(F.lit(11), digest("doc_id", "text")))
    order = Window.partitionBy(label).orderBy("_key")
    first = keyed.select(label, "_key").distinct().withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    return keyed.join(first.select(label, "_key"), [label, "_key"]).dropDuplicates([label, "_key"]).drop("_key")
