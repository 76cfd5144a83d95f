"""Trees from histograms against plain versions; training that stops and goes on; balanced bootstraps."""

import json
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from threadsieve.operators import boosting, forest, growth, trees
from threadsieve.operators.resident import Resident


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)) * (rng.random((600, 4)) < 0.7)
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0.2).astype(int)
    rows = [(i, Vectors.dense(v) if i % 2 else Vectors.sparse(4, [(j, float(t)) for j, t in enumerate(v) if t]), int(t), i % 4 == 0)
            for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["id", "features", "target", "is_val"]).cache()


def plain_boosting(x, y, held, binning, options):
    """Row-wise boosting with the same bins: splits by trying every threshold of every feature."""
    w = np.where(y == 1, (y[~held] == 0).sum() / (y[~held] == 1).sum(), 1.0)
    margin, losses, margins = np.zeros(len(y)), [], []

    def grow(rows, g, h, depth):
        def leaf(r):
            return -options.step * g[r].sum() / (h[r].sum() + options.penalty)

        def worth(r):
            return g[r].sum() ** 2 / (h[r].sum() + options.penalty)

        if depth == 0:
            return leaf(rows)
        best = (1e-9, None)
        for f, ts in enumerate(binning.thresholds):
            for t in ts:
                left = rows & (x[:, f] <= t)
                right = rows & ~left
                if h[left].sum() >= options.least and h[right].sum() >= options.least:
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > best[0]:
                        best = (gain, (f, t, left, right))
        if best[1] is None:
            return leaf(rows)
        f, t, left, right = best[1]
        return f, t, grow(left, g, h, depth - 1), grow(right, g, h, depth - 1)

    def value(tree, v):
        while isinstance(tree, tuple):
            tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
        return tree

    while len(losses) < options.rounds:
        p = 1 / (1 + np.exp(-margin))
        g, h = growth.exact(w * (p - y)), growth.exact(w * p * (1 - p))
        tree = grow(~held, g, h, options.depth)
        margin = margin + np.array([value(tree, v) for v in x])
        margins.append(margin)
        losses.append((w * np.logaddexp(0, np.where(y > 0, -margin, margin)))[held].sum() / w[held].sum())
        if len(losses) - 1 - int(np.argmin(losses)) >= options.patience:
            break
    return margins[int(np.argmin(losses))], losses


def test_boosting_equals_a_plain_version_and_ends_after_its_patience(spark, points, tmp_path):
    x, y, df = points
    held = np.arange(len(y)) % 4 == 0
    options = boosting.Options(rounds=60, depth=3, step=0.3, patience=5)
    model = trees.train_gbt(df, validation="is_val", options=options)
    binning = growth.fit_binning(df.where("not is_val"))
    margin, losses = plain_boosting(x, y, held, binning, options)
    assert 1 < model.size == 1 + int(np.argmin(losses)) <= len(losses) - 5 < 60
    got = trees.score(model, df).orderBy("id").toPandas()[trees.PROB].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-margin)), atol=1e-9)
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = trees.score(PipelineModel.load(str(tmp_path / "m")), df).orderBy("id").toPandas()[trees.PROB].to_numpy()
    assert (again == got).all()


def test_stopped_and_resumed_training_gives_the_same_trees(spark, points, tmp_path, monkeypatch):
    _, _, df = points
    options = boosting.Options(rounds=9, depth=2, rows=0.8, features=0.75, metric="average_precision", patience=20)
    monkeypatch.setattr(boosting, "KEEP_EVERY", 100)
    whole = trees.train_gbt(df, validation="is_val", options=options, folder=f"{tmp_path}/a")
    monkeypatch.setattr(boosting, "KEEP_EVERY", 2)
    for pause in (1, 4, 5):
        trees.train_gbt(df, validation="is_val", options=options, folder=f"{tmp_path}/b", pause=pause)
    assert boosting.resume(spark, f"{tmp_path}/b").written == 5
    resumed = trees.train_gbt(df.limit(0), validation="is_val", folder=f"{tmp_path}/b")
    assert resumed.getOrDefault("trees") == whole.getOrDefault("trees") and whole.size > 1


def test_trees_do_not_depend_on_partitions_or_on_who_adds_up(spark, points, monkeypatch):
    _, _, df = points
    wanted = trees.train_gbt(df, validation="is_val", rounds=3)
    monkeypatch.setattr(growth, "PARTITION_BYTES", 500)
    monkeypatch.setattr(growth, "BLOCK_ROWS", 90)
    monkeypatch.setattr(growth, "DRIVER_BYTES", 0)
    monkeypatch.setattr(growth, "FEATURES_AT_ONCE", 3)
    assert trees.train_gbt(df.repartition(6), validation="is_val", rounds=3).getOrDefault("trees") == wanted.getOrDefault("trees")


@pytest.mark.parametrize("changed", [{}, {"rows": 0.7, "rows_every": 2, "features": 0.6, "metric": "auc"}, {"depth": 1}])
def test_rows_of_one_task_are_read_once_and_give_the_trees_of_passes(spark, points, monkeypatch, changed):
    _, _, df = points
    options = boosting.Options(**{"rounds": 7, "depth": 4, "patience": 3, "step": 0.3} | changed)
    passes, one = [], boosting.Booster._pass
    monkeypatch.setattr(boosting.Booster, "_pass", lambda self, *a, **b: passes.append(a) or one(self, *a, **b))
    monkeypatch.setattr(growth, "BLOCK_ROWS", 90)
    wanted = trees.train_gbt(df, validation="is_val", options=options)
    # at most the measure of the last round
    assert len(passes) <= 1
    monkeypatch.setattr(boosting, "CELLS_IN_TASK", 0)
    assert trees.train_gbt(df, validation="is_val", options=options).getOrDefault("trees") == wanted.getOrDefault("trees")
    assert len(passes) > 3 and wanted.size > 1


def test_histograms_of_one_task_are_those_of_passes():
    rng = np.random.default_rng(4)
    zero, blocks = np.array([1, 0, 2, 0], np.uint8), []
    for number in range(3):
        x = np.where(rng.random((70, 4)) < 0.5, rng.integers(0, growth.BINS, (70, 4)), zero).astype(np.uint8)
        blocks.append(growth.Block(number, x, rng.integers(0, 2, 70).astype(float), np.ones(70), rng.random(70) < 0.2, rng.normal(size=70)))
    held = Resident(blocks[::-1], zero, boosting.Options(least=0.1), lambda b: b.margin, boosting.loss_sums, boosting.measured)
    tree, frontier = growth.Tree(), [0]
    for _ in range(4):
        found = held.look(0, tree, frontier, True)
        total = 0.0
        for b in blocks:
            p, node = boosting.sigmoid(b.margin), tree.walk(b.x)
            slots = np.full(len(tree.left), -1)
            slots[frontier] = np.arange(len(frontier))
            g, h = growth.exact(b.w * (p - b.y)), growth.exact(b.w * p * (1 - p))
            total = total + growth.histogram(b.x, np.where(b.held, -1, slots[node]), len(frontier), g, h, zero)
        for slot, node in enumerate(frontier):
            assert (np.moveaxis(held.sums[node], 0, -1) == total[slot]).all()
        best = {r["slot"]: r for r in found}
        assert best.keys() == {-1, *range(len(frontier))}
        frontier = [c for slot, node in enumerate(frontier) for c in tree.split(node, best[slot]["feature"], best[slot]["bin"], (0.0, 0.0))]
    held.end(tree)
    assert [r.number for r in held.rows] == [0, 1, 2] and all((r.node == tree.walk(b.x)).all() for r, b in zip(held.rows, blocks))


def test_measures():
    rng = np.random.default_rng(1)
    y, margin = rng.integers(0, 2, 500), np.round(rng.normal(size=500), 1)
    level = np.rint(boosting.sigmoid(margin) * (boosting.LEVELS - 1))
    pairs = [(a > b) + (a == b) / 2 for a in level[y == 1] for b in level[y == 0]]
    assert np.isclose(1 - boosting.measured("auc", boosting.loss_sums("auc", y, np.ones(500), margin)), np.mean(pairs))
    steps, before = 0.0, 0
    for t in sorted(set(level), reverse=True):
        tp = int((y[level >= t] == 1).sum())
        steps, before = steps + (tp - before) / y.sum() * tp / (level >= t).sum(), tp
    assert np.isclose(1 - boosting.measured("average_precision", boosting.loss_sums("average_precision", y, np.ones(500), margin)), steps)
    assert set(boosting.PRESETS) == {"auc", "average_precision", "logloss"}
    assert json.loads(json.dumps(asdict(boosting.PRESETS["auc"])))["step"] == 2e-5


def test_histogram_counts_zeros_too():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (300, 6)).astype(np.uint8) * (rng.random((300, 6)) < 0.4).astype(np.uint8)
    slot, g, h = rng.integers(-1, 3, 300), growth.exact(rng.normal(size=300)), np.ones(300)
    zero = np.array([0, 0, 2, 0, 1, 0], np.uint8)
    got = growth.histogram(x, slot, 3, g, h, zero)
    for s in range(3):
        for f in range(6):
            for b in range(5):
                at = (slot == s) & (x[:, f] == b)
                assert got[s, f, b].tolist() == [g[at].sum(), at.sum()]


def test_balanced_bootstraps(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(20_000) < 0.05).astype(float)
    block = growth.Block(7, np.zeros((20_000, 1), np.uint8), y, y, y > 2, y)
    rates = (y.sum() / (1 - y).sum(), 1.0)
    for number in range(5):
        weight = forest.bag(block, number, rates, 101)
        ones, zeros = weight[y > 0].sum(), weight[y == 0].sum()
        assert abs(ones - y.sum()) < 5 * np.sqrt(y.sum()) and abs(zeros - y.sum()) < 5 * np.sqrt(y.sum())
        assert 0.3 < (weight[y > 0] == 0).mean() < 0.44 and weight.max() > 1
    assert (forest.bag(block, 1, rates, 101) != forest.bag(block, 2, rates, 101)).any()
    share = np.bincount(forest.fold_of(block, 5, 101)) / 20_000
    assert len(share) == 5 and abs(share - 0.2).max() < 0.02


def test_grid_points_are_parts_of_the_deepest_largest_forest(spark, points):
    x, y, df = points
    model, measures = forest.balanced_forest(df, counts=(4, 9), depths=(2, 5), folds=3)
    assert set(measures) == {(4, 2), (9, 2), (4, 5), (9, 5)} and all(len(m) == 3 for m in measures.values())
    best = max(measures, key=lambda p: (np.mean(measures[p]), -p[1], -p[0]))
    assert model.size == best[0]
    alone, only = forest.balanced_forest(df, counts=(best[0],), depths=(best[1],), folds=3)
    assert np.allclose(only[best], measures[best]) or best[0] == 4  # tree numbers of a fold follow the largest count
    if best[0] == 9:
        assert alone.getOrDefault("trees") == model.getOrDefault("trees")
    p = trees.score(model, df).orderBy("id").toPandas()[trees.PROB].to_numpy()
    assert ((p > 0.5) == y).mean() > 0.8 and 0 <= p.min() and p.max() <= 1


def test_average_precision_of_unseen_rows(spark, points):
    """The measure of a point, from the trees themselves, row by row."""
    _, _, df = points
    binning = growth.fit_binning(df)
    blocks = growth.blocks(df, binning, "target", F.lit(1.0), F.lit(False))
    grown = forest.Forest(blocks, binning, 3, 2, (1.0, 0.6), 11)
    grown.grow(4)
    rows = [b for b in growth.read_blocks(iter(blocks.toArrow().to_batches()), len(binning.thresholds))]
    got = grown.average_precisions((2, 3), (1, 4))
    for (count, depth), areas in got.items():
        for fold in range(2):
            score, label = [], []
            for block in rows:
                own = forest.fold_of(block, 2, 11) == fold
                parts = [np.array(t.value)[t.walk(block.x[own], depth)] for t in grown.trees[fold * 3:fold * 3 + count]]
                score += np.mean(parts, axis=0).tolist()
                label += block.y[own].tolist()
            level, label = np.rint(np.array(score) * (boosting.LEVELS - 1)), np.array(label)
            area, before = 0.0, 0
            for t in sorted(set(level), reverse=True):
                tp = label[level >= t].sum()
                area, before = area + (tp - before) / label.sum() * tp / (level >= t).sum(), tp
            assert np.isclose(areas[fold], area)
    for number, tree in enumerate(grown.trees):
        assert max(tree.level) <= 4 and (np.array(tree.value) >= 0).all() and (np.array(tree.value) <= 1).all(), number


def test_one_class_no_rows_and_no_validation(spark, points):
    _, _, df = points
    ones = df.where("target = 1")
    assert trees.score(trees.train_gbt(ones, rounds=2), ones).agg(F.min(trees.PROB)).first()[0] > 0.5
    assert trees.score(trees.train_rf_cv(ones, trees=(2,), depths=(2,), folds=2), ones).agg(F.min(trees.PROB)).first()[0] == 1.0
    empty = trees.train_gbt(df.limit(0), rounds=2)
    assert trees.score(empty, df).agg(F.min(trees.PROB), F.max(trees.PROB)).first()[0] == 0.5
    assert trees.train_gbt(df.where("not is_val"), validation="is_val", rounds=2).size == 2


def test_scoring_makes_a_vector_once_and_ends_at_leaves(spark):
    binning = growth.Binning([[-1.0, 0.0, 1.0]] * 5)
    deep, flat = growth.Tree(), growth.Tree(value=[0.25])
    deep.split(deep.split(0, 3, 1, (-0.5, 0.75))[1], 1, 2, (0.5, 2.0))
    model = growth.TreesModel.of([deep, flat], binning, "mean")
    data = [[0, 0, 0, 0, 0], [9, 2, 9, 0.5, 9], [9, 1, 9, 0.5, 9], [0, float("nan"), 0, float("inf"), 0], [0, 5, 0, -0.5, 0]]
    frame = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(data)], ["id", "dense"])
    made = F.udf(lambda v: Vectors.sparse(5, [(i, x) for i, x in enumerate(v) if x]), frame.schema["dense"].dataType)
    for features in (F.col("dense"), made("dense")):
        scored = trees.score(model, frame.select("id", features.alias("features")))
        assert {r.id: r.prob_pred for r in scored.collect()} == {0: -0.125, 1: 1.125, 2: 0.375, 3: 1.125, 4: -0.125}
    # a lambda that asks for the vector makes it again at every node
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_scoring_without_a_split(spark):
    frame = spark.createDataFrame([(Vectors.sparse(3, []),), (Vectors.dense([1.0, 2.0, 3.0]),)], ["features"])
    model = growth.TreesModel.of([growth.Tree(value=[0.5])], growth.Binning([[0.0]] * 3), "mean")
    assert [r.prob_pred for r in trees.score(model, frame).collect()] == [0.5, 0.5]


def test_margins_walk_only_new_trees(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (50, 3)).astype(np.uint8)
    block = growth.Block(3, x, np.zeros(50), np.ones(50), np.zeros(50, bool), rng.normal(size=50))
    grown = [growth.Tree() for _ in range(4)]
    for i, tree in enumerate(grown):
        tree.split(0, i % 3, 1, (0.1 * i - 0.3, 0.7))
    walked, walk = [], growth.Tree.walk
    monkeypatch.setattr(growth.Tree, "walk", lambda self, x: walked.append(self) or walk(self, x))
    for n in (1, 1, 3, 4, 2):
        assert (boosting.margins(block, grown[:n], 10, "one") == boosting.margins(block, grown[:n])).all()
    # 1, 2, 1 new ones; fewer trees than kept are walked again from those just made
    assert len(walked) == (1 + 1 + 3 + 4 + 2) + 1 + 0 + 2 + 1 + 2
    # margins of another training, or from before the stored ones, do not count
    assert (boosting.margins(block, grown[:1], 10, "two") == boosting.margins(block, grown[:1])).all()
    assert (boosting.margins(block, grown[:1], 40, "two") == boosting.margins(block, grown[:1])).all()


def test_features_of_many_nodes_are_those_of_each():
    nodes = list(range(5, 5 + 2 * growth.NODES_AT_ONCE + 1))
    got = growth.chosen_features(7, 2, nodes, 40, 6)
    assert (got == np.concatenate([growth.chosen_features(7, 2, [n], 40, 6) for n in nodes])).all()
