"""Null scores and times: they rank last, count nowhere as hits, and lose no row."""

import datetime

from threadsieve.operators import evaluation, runs, splits


def scored(spark, nulls):
    rows = [(i, i / 20, int(i >= 12)) for i in range(20)] + [(100 + i, None, 0) for i in range(nulls)]
    return spark.createDataFrame(rows, "snapshot_id long, prob double, target int")


def test_null_scores_leave_the_curve_as_it_is(spark):
    plain, holed = (
        sorted(tuple(r) for r in evaluation.threshold_curve(scored(spark, n)).collect()) for n in (0, 5))
    assert plain == holed
    plain, holed = (sorted(tuple(r) for r in evaluation.roc_pr_curve(scored(spark, n)).collect()) for n in (0, 5))
    assert plain == holed


def test_null_scores_rank_last(spark):
    got = {r.share: r for r in evaluation.lift_gain(scored(spark, 20), [0.1, 0.2]).collect()}
    assert (got[0.1].hits, got[0.2].hits) == (4, 8)


def test_no_positives_and_no_duration(spark):
    none = scored(spark, 0).where("target = 0")
    assert [r.gain for r in evaluation.lift_gain(none, [0.5]).collect()] == [None]
    idle = spark.createDataFrame([("m", 0.0)], "model string, duration double")
    assert runs.latency_summary(idle, ["model"]).first().throughput is None


def test_null_times_are_the_oldest(spark):
    start = datetime.datetime(2023, 1, 1)
    rows = [(i, start + datetime.timedelta(days=i) if i < 10 else None, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "snapshot_id long, time timestamp, target int")
    val = {r.snapshot_id for r in splits.split_newest(df, 0.2).where("data_type = 'val'").collect()}
    assert val == {6, 7, 8, 9}
    assert [r["count"] for r in splits.shard(df, 4).groupBy("shard").count().collect()] == [5] * 4
