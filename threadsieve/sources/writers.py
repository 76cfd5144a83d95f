"""Sinks: shards, prediction files, metric rows, model bundles."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadsieve.schemas import PREDICTION


def write_shards(df: DataFrame, path: str, shards: int | None = None, by: str | None = None) -> str:
    """Replace a folder of Parquet shards: ``shards`` even files, or one folder
    per value of ``by``."""
    out = df.repartition(shards) if shards else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def write_predictions(df: DataFrame, path: str, extra: list[str] | None = None) -> str:
    """Prediction CSV in the fixed field order, quoted, one folder per ``min_recall``."""
    fields = [f.name for f in PREDICTION.fields if f.name in df.columns]
    (
        df.select("min_recall", *fields, *(extra or []))
        .write.mode("overwrite").option("header", True).option("quoteAll", True)
        .partitionBy("min_recall").csv(path)
    )
    return path


def append_metrics(df: DataFrame, path: str) -> str:
    """Append the metric rows of a run."""
    df.write.mode("append").parquet(path)
    return path


def save_bundle(model: PipelineModel, threshold: float | None, path: str) -> str:
    """Vectoriser, classifier and threshold in one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    row = spark.range(1).select(F.lit(threshold).cast("double").alias("best_threshold"))
    row.write.mode("overwrite").parquet(f"{path}/threshold")
    return path


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, float | None]:
    threshold = spark.read.parquet(f"{path}/threshold").first().best_threshold
    return PipelineModel.load(f"{path}/model"), threshold
