"""Class-imbalance sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.functions.keys import digest, digest_level, seeded_long
from threadsieve.operators.ranking import positions, rank_cuts
from threadsieve.session import store


def _numbered(df: DataFrame, target: str, row_id: str) -> DataFrame:
    rows = df.where(F.col(target).isNotNull()).select(
        F.col(target), F.col(row_id), digest(F.col(row_id)).alias("_digest")
    ).withColumn("_l1", digest_level(F.col("_digest")))
    # Read four times below, so it is written once: ids and numbers only.
    numbered = positions(rows, [target], "_l1", [F.col("_digest"), F.col(row_id)])
    return store(numbered.select(target, row_id, "position"), "numbered")


def _with_draws(df: DataFrame, numbered: DataFrame, draws: DataFrame, seed: int, target: str, row_id: str) -> DataFrame:
    """Resolve draw numbers to negatives and fetch the wide rows in one join."""
    negatives = numbered.where(F.col(target) == 0)
    size = negatives.select(F.count("*").alias("n")).scalar()
    # Without negatives the slot is null and no draw finds a row.
    slot = F.pmod(seeded_long(F.col("draw"), seed), F.nullif(size, F.lit(0))) + 1
    picked = (
        draws.select(slot.alias("position"), "draw")
        .join(negatives.select("position", row_id), "position")
        .select(row_id, "draw")
    )
    positives = numbered.where(F.col(target) == 1).select(row_id, F.lit(None).cast("long").alias("draw"))
    return df.join(positives.unionByName(picked), row_id).select(*df.columns, "draw")


def undersample_ratio(
    df: DataFrame, ratio: int = 5, seed: int = 101, target: str = "target", row_id: str = "snapshot_id"
) -> DataFrame:
    """All positives and ``ratio`` negatives per positive, drawn with replacement.

    ``draw`` numbers the draws (null on positives): a negative drawn twice is
    two rows. Negatives are numbered by digest order, and draw i takes number
    ``hash(seed, i) mod n``; only ids travel until the final join.
    """
    numbered = _numbered(df, target, row_id)
    first = F.col("position") - 1
    draws = numbered.where(F.col(target) == 1).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(ratio - 1)), lambda r: first * ratio + r)).alias("draw")
    )
    return _with_draws(df, numbered, draws, seed, target, row_id)


def undersample_n(
    df: DataFrame, n: int, seed: int = 101, target: str = "target", row_id: str = "snapshot_id"
) -> DataFrame:
    """All positives and ``n`` negatives drawn with replacement."""
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    return _with_draws(df, _numbered(df, target, row_id), draws, seed, target, row_id)


def sample_prevalence(
    df: DataFrame, ratio: int = 5, seed: int = 101, target: str = "target", row_id: str = "snapshot_id"
) -> DataFrame:
    """``n_pos * (1 + ratio)`` rows of any class in seeded digest order."""
    rows = df.select(
        F.lit(0).alias("_all"), F.col(target), digest(F.col(row_id), seed).alias("_digest")
    ).withColumn("_l1", digest_level(F.col("_digest")))
    wanted = rows.groupBy("_all").agg(
        F.count("*").alias("_n"), F.count_if(F.col(target) == 1).alias("_pos")
    ).select("_all", F.array(F.least("_n", F.col("_pos") * (1 + ratio))).alias("ks"))
    cut = rank_cuts(
        rows, wanted, ["_all"], ["_l1"], ["_digest"], ["_digest"]
    ).select("_digest").scalar()
    return df.where(digest(F.col(row_id), seed) <= cut)


def sample_rows(df: DataFrame, n: int, seed: int = 101, row_id: str = "snapshot_id") -> DataFrame:
    """``n`` rows in seeded digest order, for a small report."""
    return df.orderBy(digest(F.col(row_id), seed), F.col(row_id)).limit(n)
