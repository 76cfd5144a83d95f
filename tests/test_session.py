"""Stage tables and what is left of their making."""

import time

from pyspark.sql import functions as F

from threadsieve import session


def shuffle_blocks(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(i).name() for i in range(blocks.size()) if blocks.apply(i).isShuffle()}


def test_shuffles_of_a_stored_table_are_deleted(spark):
    before = shuffle_blocks(spark)
    made = spark.range(5000).withColumn("k", F.col("id") % 70).repartition(5, "id").groupBy("k").agg(F.sum("id").alias("s"))
    stored = session.store(made, "sums")
    deadline = time.time() + 20
    while shuffle_blocks(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_blocks(spark) - before
    assert spark.conf.get(session.SHUFFLES_GO, None) is None
    # the plan it was made from can run again
    assert sorted(stored.collect()) == sorted(made.collect()) == sorted(session.store(made, "sums").collect())
