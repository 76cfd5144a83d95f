"""Operators on small frames: edge cases, properties, brute force."""

import datetime
import random
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from threadsieve.functions.keys import digest, digest_level
from threadsieve.operators import (
    distributions, evaluation, monitoring, packing, ranking, rows, runs, sampling, splits, tfidf, threads, trees,
)

DAY = datetime.datetime(2023, 5, 1)


def messages(spark, data):
    return spark.createDataFrame(
        data, "snapshot_id long, thread_id long, time timestamp_ntz, is_complaint string, is_feedback string"
    )


def test_dedup_ties_and_nulls(spark):
    df = messages(spark, [
        (3, 1, DAY, "N", None), (2, 1, DAY, None, None), (4, 1, DAY - datetime.timedelta(days=1), "Y", None),
        (5, None, DAY, None, None),
    ])
    assert [r.snapshot_id for r in threads.latest_per_thread(df).collect()] == [2]
    assert [r.snapshot_id for r in threads.complaint_first_per_thread(df).collect()] == [4]
    kept = threads.latest_per_thread(df, keep_null_keys=True).collect()
    assert sorted(r.snapshot_id for r in kept) == [2, 5]


def test_dedup_prunes_before_the_shuffle(spark):
    df = messages(spark, [(1, 1, DAY, None, None)])
    plan = threads.latest_per_thread(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_labels(spark):
    df = messages(spark, [(1, 1, DAY, "Y", None), (2, 1, DAY, None, "Y"), (3, 1, DAY, None, None)])
    got = df.select(rows.complaint().alias("a"), rows.complaint(True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 1), (0, 1), (0, 0)]


def test_month_tokens():
    assert splits.month_start("11_22") == "2022-11-01"
    with pytest.raises(ValueError):
        splits.month_start("13_22")


def test_exclude_one_year_only(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2022-08-05 00:00:00' t UNION ALL SELECT TIMESTAMP_NTZ'2023-08-05 00:00:00' UNION ALL SELECT NULL")
    assert rows.exclude_months(df, [(2022, 8)], "t").count() == 2


@pytest.mark.parametrize("task_rows", [0, 5, 1_000_000])
def test_rank_cuts_whatever_the_depth(spark, task_rows):
    rng = random.Random(5)
    data = [(rng.randint(0, 1), rng.randint(0, 3), rng.randint(0, 3), i) for i in range(400)]
    df = spark.createDataFrame(data, "g int, a int, b int, id long").withColumn("d", digest(F.col("id")))
    df = df.withColumn("c", digest_level(F.col("d")))
    wanted = spark.createDataFrame([(0, [1, 7, 100]), (1, [3, 150])], "g int, ks array<int>")
    got = {
        (r.g, r["rank"]): r.id for r in
        ranking.rank_cuts(df, wanted, ["g"], ["a", "b", "c"], ["d"], ["id"], task_rows).collect()
    }
    digests = {r.id: r.d for r in df.collect()}
    want = {}
    for g, ks in ((0, [1, 7, 100]), (1, [3, 150])):
        ordered = sorted((a, b, digests[i], i) for gg, a, b, i in data if gg == g)
        want.update({(g, k): ordered[k - 1][3] for k in ks})
    assert got == want


def test_positions_are_dense(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("d", digest(F.col("id")))
    df = df.withColumn("l", digest_level(F.col("d")))
    got = ranking.positions(df, ["g"], "l", [F.col("d")]).groupBy("g").agg(
        F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("n"),
    ).orderBy("g").collect()
    assert [(r.lo, r.hi, r.n) for r in got] == [(1, 334, 334), (1, 333, 333), (1, 333, 333)]


def test_newest_split_sizes_with_one_time_and_tiny_class(spark):
    df = spark.range(101).select(
        F.col("id").alias("snapshot_id"), F.lit(DAY).cast("timestamp_ntz").alias("time"),
        F.when(F.col("id") == 7, 1).otherwise(0).alias("target"),
    )
    got = splits.split_newest(df, 0.2)
    counts = {(r.target, r.data_type): r["count"] for r in got.groupBy("target", "data_type").count().collect()}
    assert counts == {(0, "val"): 20, (0, "train"): 80, (1, "train"): 1}
    shuffled = splits.split_shuffled(df, 0.2)
    assert shuffled.where("data_type = 'val'").count() == 20 and shuffled.count() == 101


@pytest.mark.parametrize("n, rows_", [(3, 10), (7, 5), (1, 4)])
def test_shard_sizes(spark, n, rows_):
    df = spark.range(rows_).select(F.col("id").alias("snapshot_id"), F.lit(DAY).cast("timestamp_ntz").alias("time"))
    sizes = {r.shard: r["count"] for r in splits.shard(df, n).groupBy("shard").count().collect()}
    assert sizes == {i: len(part) for i, part in enumerate(np.array_split(np.arange(rows_), n)) if len(part)}


def test_undersampling_keeps_positives_and_repeats(spark):
    df = spark.range(40).select(F.col("id").alias("snapshot_id"), F.when(F.col("id") < 10, 1).otherwise(0).alias("target"))
    got = sampling.undersample_ratio(df, 5, 1).collect()
    assert sorted(r.snapshot_id for r in got if r.target == 1) == list(range(10))
    drawn = [r for r in got if r.target == 0]
    assert len(drawn) == 50 and sorted(r.draw for r in drawn) == list(range(50))
    assert len({r.snapshot_id for r in drawn}) < 50
    assert sampling.sample_prevalence(df, 1, 1).count() == 20


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(0, 1)] * 6 + [(5, 0)] * 2 + [(9, 1)] * 2, "v int, t int")
    got = distributions.quantile_bins(df, "v", "t", 4).orderBy("bin").collect()
    assert sum(r.n for r in got) == 10
    assert [(r.low, r.high) for r in got] == [(0.0, 5.0), (5.0, 9.0)]


def test_early_stop(spark):
    metric = [5.0, 4.0, 4.0, 4.5, 4.2, 3.0]
    df = spark.createDataFrame(list(enumerate(metric)), "epoch int, perplexity double")
    r = runs.early_stop(df, 2).first()
    assert (r.best_epoch, r.best_metric, r.last_epoch) == (1, 4.0, 4)
    assert runs.early_stop(df, 0).first().last_epoch == 5


def test_perplexity_overflow(spark):
    df = spark.createDataFrame([(1, 2000.0), (2, 0.0)], "epoch int, loss double")
    got = {r.epoch: r.perplexity for r in runs.perplexity(df, ["epoch"]).collect()}
    assert got == {1: float("inf"), 2: 1.0}


def scores(spark, pairs):
    return spark.createDataFrame(
        [(i, t, float(p)) for i, (t, p) in enumerate(pairs)], "snapshot_id long, target int, prob double"
    )


def test_score_on_a_grid_point(spark):
    values = [i * 0.0001 for i in range(0, 10001, 7)]
    df = scores(spark, [(1, v) for v in values])
    curve = {r.i: r.predicted for r in evaluation.threshold_curve(df).collect()}
    grid = np.arange(10100) * 0.0001
    data = np.array(values)
    assert all(curve[i] == int((data >= grid[i]).sum()) for i in range(10100))


def test_no_threshold_reaches_the_recall(spark):
    df = scores(spark, [(1, -1.0), (0, 0.5)])
    assert evaluation.threshold_for_recall(df, 0.5).first().best_threshold is None
    assert evaluation.threshold_for_f1(scores(spark, [(0, 0.4), (0, 0.6)])).first().best_threshold is None


def test_strict_application_and_pr_anchor(spark):
    df = scores(spark, [(1, 0.9), (0, 0.8), (1, 0.5), (0, 0.1)])
    r = evaluation.evaluate(df, 0.5).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1)
    # recall 0 -> 1/2 at precision 1; 1/2 -> 1/2; 1/2 -> 1 between 1/2 and 2/3.
    assert r.pr_auc == pytest.approx(0.5 * 1.0 + 0.5 * (0.5 + 2 / 3) / 2)
    assert r.roc_auc == pytest.approx(0.75)


def test_areas_of_random_scores(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(500)]
    r = evaluation.evaluate(scores(spark, pairs), 0.5).first()
    pos, neg = [p for t, p in pairs if t], [p for t, p in pairs if not t]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert r.roc_auc == pytest.approx(want)


def test_recall_never_rises_with_the_threshold(spark):
    rng = random.Random(2)
    df = scores(spark, [(rng.randint(0, 1), rng.random()) for _ in range(300)])
    recall = [r.recall for r in evaluation.threshold_curve(df).orderBy("i").collect()]
    assert all(a >= b for a, b in zip(recall, recall[1:])) and recall[0] == 1.0


def test_response_rate_of_an_empty_top(spark):
    df = scores(spark, [(1, 0.9), (0, 0.1)])
    got = {r.top: r.response_rate for r in evaluation.response_rate(df, [0.1, 0.5]).collect()}
    assert got == {"10%": None, "50%": 1.0}


def test_day_of_one_class(spark):
    df = scores(spark, [(0, 0.9), (0, 0.2)]).withColumn("day", F.lit("d"))
    daily = monitoring.compare_models(df, {"m": F.col("prob") > 0.5}, by=["day"])
    rates = {r.model: (r.precision, r.recall) for r in monitoring.daily_rates(daily, ["day"]).collect()}
    assert set(rates.values()) == {(0.0, 1.0)}
    errors = monitoring.daily_errors(daily, ["day"])
    assert {(r.fp, r.fn) for r in errors.collect()} == {(0, 0)}
    assert monitoring.false_positive_reduction(errors, ["day"]).first().reduction_pct is None


def test_confusion_has_empty_cells(spark):
    df = rows.apply_threshold(scores(spark, [(1, 0.9)]))
    assert {(r.target, r.predicted): r.n for r in evaluation.confusion_matrix(df).collect()} == {
        (0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_tfidf_rows_have_unit_length(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("snapshot_id"), F.col("text").alias("preprocessed_email"))
    model = tfidf.fit_vectors(texts, max_features=500)
    vocab = tfidf.vocabulary_of(model)
    assert vocab == sorted(vocab) and len(vocab) == 500
    long = tfidf.explode_vectors(tfidf.vectorize(model, texts), vocab)
    norms = long.groupBy("snapshot_id").agg(F.sum(F.col("tfidf") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1.0) for r in norms)


def test_packing_drops_the_remainder(spark):
    df = spark.createDataFrame([(0, 0, ["a", "b", "c"]), (0, 1, ["d"] * 7), (0, 2, []), (1, 0, ["e"] * 3)],
                               "batch int, place int, tokens array<string>")
    got = {(r.batch, r.chunk): r.tokens for r in packing.pack(df, "tokens", "batch", "place", 4).collect()}
    assert got == {(0, 0): ["a", "b", "c", "d"], (0, 1): ["d"] * 4}


def test_batch_scoring_keeps_keys(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(300)] + [(300, None)], "id long, t string")

    def factory():
        return lambda texts: np.array([len(t) for t in texts]) / 1000

    got = {r.id: r.prob_pred for r in trees.score_in_batches(df, factory, "t", ["id"], 7).collect()}
    assert got == {**{i: i / 1000 for i in range(300)}, 300: 0.0}


def test_trees_find_a_planted_signal(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from threadsieve.plans import training
    from threadsieve.sources import writers

    rng = random.Random(3)
    data = []
    for i in range(400):
        bad = rng.random() < 0.3
        words = rng.choices("alpha beta gamma delta epsilon".split(), k=12) + (["terrible", "refund"] if bad else [])
        rng.shuffle(words)
        kind = "train" if i < 250 else "val" if i < 320 else "test"
        data.append((i, i, DAY, kind, int(bad), " ".join(words)))
    corpus = spark.createDataFrame(
        data, "snapshot_id long, thread_id long, time timestamp_ntz, data_type string, target int, preprocessed_email string"
    )
    path = training.train_bundle(corpus, str(tmp_path / "bundle"), 0.8, 50, rounds=5, depth=2)
    model, threshold = writers.load_bundle(spark, path)
    assert isinstance(model, PipelineModel) and 0 < threshold < 1
    test = corpus.where("data_type = 'test'")
    scored = training.score_messages(test, model, threshold)
    r = evaluation.evaluate(scored, threshold, trees.PROB).first()
    assert r.roc_auc > 0.95 and r.recall > 0.8
    again = training.score_messages(test, writers.load_bundle(spark, path)[0], threshold)
    a = {x.snapshot_id: x.prob_pred for x in scored.collect()}
    assert a == {x.snapshot_id: x.prob_pred for x in again.collect()}


def test_stream_equals_batch(spark, sf):
    from registry import streams, text as _  # noqa: F401
    from registry.monitoring import LIMITS
    from registry.views import scored
    got = {(r.day, r.model): (r.tp, r.fp, r.fn) for r in streams.stream_daily_errors(spark, sf).collect()}
    want = {}
    for model, limit in LIMITS.items():
        days = scored(spark, sf, model).withColumn("day", F.date_format("time", "yyyy-MM-dd"))
        batch = monitoring.compare_models(days, {"m": F.col("prob") > limit}, by=["day"]).where("model = 'm'")
        want |= {(r.day, model): (r.tp, r.fp, r.fn) for r in batch.collect()}
    assert got == want


def test_bad_extract_rows_are_kept(spark, tmp_path):
    from threadsieve.sources import readers
    folder = tmp_path / "email_data_0823_to_0923.csv"
    folder.write_text("snapshot_id,email,gcid,thread_id,state,time,is_complaint,is_feedback,supervised_groups\n"
                      '1,"two\nlines",g,t,closed,2023-08-01 00:00:00,Y,,\n2,x,g,t,closed,not a time,Y,,\n')
    got = {r.snapshot_id: r for r in readers.read_extracts(spark, str(tmp_path)).collect()}
    assert got["1"].email == "two\nlines" and got["1"].month_token == "0823" and got["1"]._corrupt_record is None
    assert got["2"].time is None and got["2"]._corrupt_record is not None


def test_tree_queries_use_the_operators_sizes(monkeypatch):
    from registry import models

    calls = []
    monkeypatch.setattr(models, "_corpus", lambda *a: None)
    monkeypatch.setattr(models.training, "build_features", lambda *a, **b: calls.append((a[1:], b)) or (None, None))
    monkeypatch.setattr(models.training, "train_bundle", lambda *a, **b: calls.append((a[2:], b)))
    monkeypatch.setattr(models.tfidf, "has_features", lambda t: MagicMock())
    monkeypatch.setattr(models, "F", MagicMock())
    monkeypatch.setattr(models, "scratch_path", lambda *a: "")
    monkeypatch.setattr(models.writers, "load_bundle", lambda *a: None)
    monkeypatch.setattr(models.trees, "score", lambda *a: MagicMock())
    monkeypatch.setattr(models.trees, "train_gbt", lambda *a, **b: calls.append((a[1:], b)))
    monkeypatch.setattr(models.trees, "train_rf_cv", lambda *a, **b: calls.append((a[1:], b)))
    models.train_gbt(None, "")
    models.train_rf_cv(None, "")
    models._bundle(None, "")
    sizes = {"rounds", "depth", "trees", "depths", "folds", "max_features", "options", "pause", "patience"}
    assert len(calls) == 5 and all(not a and not sizes & b.keys() for a, b in calls)
