"""Message-like views over the fixture tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadsieve.schemas import TABLES
from threadsieve.session import spread

TRAIN_UNTIL, VAL_MONTH, TEST_MONTH = "2023-07-01", "07_23", "08_23"


def table(spark: SparkSession, d: str, name: str, key: str | None = None) -> DataFrame:
    """A fixture table; with ``key`` its short scan is split for heavy row work."""
    df = spark.read.schema(TABLES[name]).parquet(f"{d}/{name}.parquet")
    return spread(df, key) if key else df


def emails(spark: SparkSession, d: str, heavy: bool = False) -> DataFrame:
    """Messages from documents and labels; ``heavy`` when texts will be rewritten."""
    docs = table(spark, d, "documents", "doc_id" if heavy else None)
    labels = table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("snapshot_id"),
        F.col("source").alias("gcid"),
        F.expr("doc_id div 3").alias("thread_id"),
        F.when(F.col("doc_id") % 10 == 9, "open").otherwise("closed").alias("state"),
        F.expr("CAST(date_add(DATE'2022-08-01', CAST((doc_id * 37) % 425 AS INT)) AS TIMESTAMP_NTZ)").alias("time"),
        F.when(F.col("toxic") == 1, "Y").when(F.col("toxic") == 0, "N").alias("is_complaint"),
        F.when(F.col("quality") == 0, "Y").when(F.col("quality") == 1, "N").alias("is_feedback"),
        F.col("text").alias("email"),
    )


EMAILS = """emails AS (
  SELECT d.doc_id AS snapshot_id, d.source AS gcid, d.doc_id // 3 AS thread_id,
         CASE WHEN d.doc_id % 10 = 9 THEN 'open' ELSE 'closed' END AS state,
         CAST(DATE '2022-08-01' + CAST((d.doc_id * 37) % 425 AS INTEGER) AS TIMESTAMP) AS time,
         CASE l.toxic WHEN 1 THEN 'Y' WHEN 0 THEN 'N' END AS is_complaint,
         CASE l.quality WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS is_feedback,
         d.text AS email
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# multiplier, signal weight and divisor of three model versions
MODELS = {"v0": (7919, 0.3, 1.3), "v1": (104729, 0.5, 1.5), "v2": (1299709, 0.1, 1.1)}


def scored(spark: SparkSession, d: str, model: str = "v0") -> DataFrame:
    """Scored messages from events: an error event is a positive."""
    m, weight, div = MODELS[model]
    hit = F.when(F.col("event_type") == "error", 1).otherwise(0)
    base = ((F.col("event_id") * m) % 10007).cast("double") / 10007
    return table(spark, d, "events").select(
        F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("thread_id"),
        F.col("ts").alias("time"), hit.alias("target"),
        ((base + F.lit(weight) * hit) / F.lit(div)).alias("prob"),
    )


def scored_sql(name: str = "scored", model: str = "v0") -> str:
    m, weight, div = MODELS[model]
    hit = "(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)"
    return f"""{name} AS (
  SELECT event_id AS snapshot_id, user_id AS thread_id, ts AS time, {hit} AS target,
         (CAST((event_id * {m}) % 10007 AS DOUBLE) / 10007 + CAST({weight} AS DOUBLE) * {hit})
           / CAST({div} AS DOUBLE) AS prob
  FROM events)"""


SCORED = scored_sql()

TARGET = "CASE WHEN is_complaint = 'Y' THEN 1 ELSE 0 END"
TARGET_WIDE = "CASE WHEN is_complaint = 'Y' OR is_feedback = 'Y' THEN 1 ELSE 0 END"


def r9(name: str, digits: int = 9):
    """Round a measure so that summation order does not show."""
    return F.round(F.col(name), digits).alias(name)
