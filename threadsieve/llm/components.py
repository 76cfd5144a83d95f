"""Connected components by minimum labels, as joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.session import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node of ``edges``: the smallest node reachable.

    Each round every node links its larger neighbours, then its smaller ones, to the smallest node it knows
    (the two star steps), so that paths shorten geometrically. Rounds end when count and hash sum
    of the edges stay. Each
    step is one aggregate and one join; tables between rounds lie in the shared folder.
    """
    now = store(edges.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("hi", "lo")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # larger neighbours of u meet the least node around u
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo <> hi").distinct()
        # smaller neighbours of u, and u itself, meet the least of them
        small = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        linked = large.join(small, large.hi == small.u)
        after = linked.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo <> hi").union(
            small.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct()
        after = store(after, "edges")
        now = after
        seen = mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(now.select("lo", "lo").distinct())
