"""Readers for message extracts, shards, run files and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadsieve.schemas import LATENCY_RUN, MESSAGE, PERPLEXITY_RUN

# Fixed value: the month token in the name of an extract.
MONTH_TOKEN = r"email_data[_=]([0-9A-Za-z-]+)"
CORRUPT = "_corrupt_record"


def read_extracts(
    spark: SparkSession, path: str | list[str], month: str | None = None, schema: T.StructType = MESSAGE,
    multi_line: bool = True,
) -> DataFrame:
    """Monthly CSV extracts with their ``month_token``; ``month`` reads only the
    files of one token.

    Bad rows are kept with their text in ``_corrupt_record``. A file whose texts
    hold line breaks cannot be split while reading, so large archives should be
    read once and stored with ``write_shards``; ``multi_line=False`` reads plain
    files in splits.
    """
    if month is not None:
        roots = [path] if isinstance(path, str) else path
        path = [f"{root.rstrip('/')}/email_data[_=]{month}*" for root in roots]
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = (
        spark.read.schema(full)
        .option("header", True).option("multiLine", multi_line).option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    df = df.withColumn("month_token", F.regexp_extract(F.col("_metadata.file_path"), MONTH_TOKEN, 1))
    # the glob also meets longer tokens with the same beginning
    return df if month is None else df.where(F.col("month_token") == month)


def month_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("month_token").agg(F.count("*").alias("n"))


def read_shards(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All shards of a folder as one table."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_list(spark: SparkSession, path: str, comment: str = ";") -> DataFrame:
    """One trimmed ``word`` per line; comment and blank lines are skipped."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .where((F.length(line) > 0) & ~F.startswith("value", F.lit(comment)))
        .select(line.alias("word"))
    )


def read_latency_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(LATENCY_RUN).csv(paths)


def read_perplexity_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(PERPLEXITY_RUN).csv(paths)
