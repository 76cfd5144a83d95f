"""Shared by the operators: input tables, whole rows beside working columns, copies of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
# Bytes of an Arrow batch. Spark's 64 MB lie in the executor's direct memory, in the pipe and in the Python worker at once, for each task.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
# Rows that one task makes when a class of identical rows is written out again.
COPIES_AT_ONCE = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan of few splits to all cores before heavy work on its rows.

    Only a read whose splits are fewer than the cores is shuffled; a large table has more and stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES``, a longer row on its own; a size set in the session stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def whole(df: DataFrame) -> Column:
    """The row as one value, so that its column names cannot clash with working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def digest(*columns) -> Column:
    """64-bit digest that tells null from empty."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c) if isinstance(c, str) else c, F.isnull(c))])


def expand(classes: DataFrame, count: str, number: str) -> DataFrame:
    """``count`` rows for each row, numbered from 0 as ``number``.

    A class may stand for a third of all rows: it is first split into chunks that are dealt anew.
    """
    chunks = classes.withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col(count) - 1) / COPIES_AT_ONCE).cast("long"))))
    few = chunks.where(F.col(count) <= COPIES_AT_ONCE)
    many = chunks.where(F.col(count) > COPIES_AT_ONCE)
    many = many.repartition("_chunk")
    low = F.col("_chunk") * COPIES_AT_ONCE
    high = F.least(F.col(count), low + COPIES_AT_ONCE) - 1
    return few.unionByName(many).withColumn(number, F.explode(F.sequence(low, high))).drop("_chunk")


def row_digest(df: DataFrame) -> Column:
    """64-bit digest of all columns of a row, maps apart."""
    return digest(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() != "map"])


def one_row_each(df: DataFrame) -> DataFrame:
    """``row, _id, _digest``: one of each set of identical rows, to be joined with what was decided for them."""
    keyed = df.select(whole(df).alias("row"), F.col("doc_id").cast("long").alias("_id"), row_digest(df).alias("_digest"))
    return keyed.dropDuplicates(["_id", "_digest"])


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
