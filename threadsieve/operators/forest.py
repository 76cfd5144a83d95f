"""Balanced random forests over a grid of tree counts and depths, judged in folds.

A tree's bootstrap is a Poisson weight per row, drawn from a hash of row and tree with a rate for each class that makes both
classes weigh the same; nothing is drawn or stored beforehand. Trees grow greedily, level by level, all of all folds together, so a shallower
tree is the upper part of a deeper one and a smaller forest the first trees of a larger one: the deepest trees of the largest
forest, grown once per fold, hold every point of the grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.operators import growth
from threadsieve.operators.boosting import LEVELS, measured
from threadsieve.operators.growth import Tree, TreesModel

COUNTS, DEPTHS = (50, 100, 200, 250, 300), (3, 6, 9, 12)
# Row weights beyond this have a probability below 1e-12 at a rate of 1.
MOST_COPIES = 16


def bag(block: growth.Block, number: int, rates: tuple[float, float], seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with the rate of its class (label 0, label 1)."""
    out = np.zeros(len(block.y), np.int64)
    u = growth.uniform(block.keys, seed, number)
    for label, rate in enumerate(rates):
        steps = np.arange(1, MOST_COPIES)
        below = np.cumsum(np.exp(-rate) * np.cumprod(np.append(1.0, rate / steps)))
        of = (block.y > 0) == bool(label)
        out[of] = np.searchsorted(below, u[of], side="right")
    return out


def fold_of(block: growth.Block, folds: int, seed: int) -> np.ndarray:
    return (growth.hashed(block.keys, seed, 1 << 40) % np.uint64(folds)).astype(np.int64)


class Forest:
    """``numbers`` name the trees: fold * ``each`` + place; trees of fold ``folds`` see all rows."""

    def __init__(self, blocks: DataFrame, binning: growth.Binning, each: int, folds: int, rates: tuple[float, float], seed: int):
        self.blocks, self.binning, self.each, self.folds, self.rates, self.seed = blocks, binning, each, folds, rates, seed
        self.partitions = blocks.rdd.getNumPartitions()
        width = len(binning.thresholds)
        self.some = max(1, int(np.sqrt(width)))
        self.trees = [Tree() for _ in range(each * (folds + 1))]

    def _groups(self, frontiers: dict[int, list[int]]) -> Iterator[list[int]]:
        """Trees whose histograms a task can hold together."""
        group, cells = [], 0
        for number, nodes in frontiers.items():
            size = len(nodes) * self.some * growth.BINS * 2
            if group and cells + size > growth.CELLS_AT_ONCE:
                yield group
                group, cells = [], 0
            group.append(number)
            cells += size
        if group:
            yield group

    def _pass(self, numbers: list[int], frontiers: dict[int, list[int]]) -> list[dict]:
        width, some, seed, folds, each, rates = len(self.binning.thresholds), self.some, self.seed, self.folds, self.each, self.rates
        # each node's features are drawn once, not for every block in every task
        sent = self.blocks.sparkSession.sparkContext.broadcast({
            n: (self.trees[n], frontiers[n], growth.chosen_features(seed, n, frontiers[n], width, some).astype(np.int32)) for n in numbers})

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for block in growth.read_blocks(batches, width):
                own = fold_of(block, folds, seed)
                for number, (tree, frontier, features) in sent.value.items():
                    weight = bag(block, number, rates, seed)
                    weight[own == number // each] = 0
                    row = np.flatnonzero(weight)
                    slots = np.full(len(tree.left), -1)
                    slots[frontier] = np.arange(len(frontier))
                    slot = slots[tree.walk(block.x[row])]
                    hist = growth.histogram_of(block.x[row], slot, features, weight[row] * block.y[row], weight[row].astype(float))
                    sums[number] = sums[number] + hist if number in sums else hist
            rows = []
            for number, hist in sums.items():
                flat = hist.reshape(-1, 2)
                at = np.flatnonzero(flat[:, 1])
                rows.append((number, 0, hist.shape[0], hist.shape[1], at.astype("<i4").tobytes() + flat[at].astype("<f8").tobytes()))
            if rows:
                types = [pa.int32()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["tree", "part", "k", "m", "hist"])

        def judge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            number, k, m = key[0].as_py(), group["k"][0].as_py(), group["m"][0].as_py()
            hist = np.zeros((k * m * growth.BINS, 2))
            for cell in group["hist"]:
                data = cell.as_py()
                n = len(data) // 20
                hist[np.frombuffer(data, "<i4", n)] += np.frombuffer(data, "<f8", offset=4 * n).reshape(n, 2)
            features = sent.value[number][2]
            found = growth.best_splits(hist.reshape(k, m, growth.BINS, 2), 0.0, 1.0)
            return growth.found_splits([(number, s, features[s, f], b, *rest) for s, f, b, *rest in found])

        size = self.partitions * sum(len(frontiers[n]) for n in numbers) * some * growth.BINS * 20
        return growth.settled(self.blocks.mapInArrow(add_up, growth.PART), judge, growth.SPLITS, size)

    def grow(self, depth: int) -> None:
        frontiers = {n: [0] for n in range(len(self.trees))}
        for _ in range(depth):
            following: dict[int, list[int]] = {}
            for numbers in self._groups(frontiers):
                for r in self._pass(numbers, frontiers):
                    tree, node = self.trees[r["tree"]], frontiers[r["tree"]][r["slot"]]
                    if node == 0:
                        tree.value[0] = r["g"] / r["h"] if r["h"] else 0.5
                    if r["gain"] <= 1e-9:
                        continue
                    sides = ((r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"]))
                    children = tree.split(node, r["feature"], r["bin"], tuple(g / h for g, h in sides))
                    # a side of one class, or of one row, has nothing left to split
                    following.setdefault(r["tree"], []).extend(c for c, (g, h) in zip(children, sides) if 0 < g < h and h > 1)
            frontiers = {n: sorted(nodes) for n, nodes in sorted(following.items()) if nodes}
            if not frontiers:
                break

    def average_precisions(self, counts: tuple[int, ...], depths: tuple[int, ...]) -> dict[tuple[int, int], list[float]]:
        """``(count, depth)``: area under the precision-recall curve of the rows of each fold, by the trees that have not seen them."""
        width, folds, each, seed = len(self.binning.thresholds), self.folds, self.each, self.seed
        grid = [(c, d) for d in depths for c in counts]
        sent = self.blocks.sparkSession.sparkContext.broadcast(self.trees[:each * folds])

        def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in growth.read_blocks(batches, width):
                own, rows = fold_of(block, folds, seed), []
                for fold in range(folds):
                    x, y = block.x[own == fold], block.y[own == fold]
                    total = np.zeros((len(depths), len(x)))
                    for place in range(max(counts)):
                        tree = sent.value[fold * each + place]
                        value = np.array(tree.value)
                        for i, depth in enumerate(depths):
                            total[i] += value[tree.walk(x, depth)]
                        if place + 1 in counts:
                            for i, depth in enumerate(depths):
                                level = np.rint(total[i] / (place + 1) * (LEVELS - 1)).astype(np.int64) + LEVELS * (y > 0)
                                at, n = np.unique(level, return_counts=True)
                                rows.append((fold, grid.index((place + 1, depth)), len(at), 0, at.astype("<i4").tobytes() + n.astype("<i8").tobytes()))
                types = [pa.int32()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["tree", "part", "k", "m", "hist"])

        def judge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            sums = np.zeros(2 * LEVELS)
            for cell in group["hist"]:
                data = cell.as_py()
                n = len(data) // 12
                sums[np.frombuffer(data, "<i4", n)] += np.frombuffer(data, "<i8", offset=4 * n)
            area = 1 - measured("average_precision", sums)
            return growth.found_splits([(key[0].as_py(), key[1].as_py(), 0, 0, area, 0.0, 0.0, 0.0, 0.0)])

        parts = self.blocks.mapInArrow(levels, growth.PART)
        found = parts.groupBy("tree", "part").applyInArrow(judge, growth.SPLITS).toArrow().to_pylist()
        out: dict[tuple[int, int], list[float]] = {point: [] for point in grid}
        for r in sorted(found, key=lambda r: r["tree"]):
            out[grid[r["slot"]]].append(r["gain"])
        return out


def balanced_forest(
    df: DataFrame, features: str = "features", target: str = "target", counts: tuple[int, ...] = COUNTS,
    depths: tuple[int, ...] = DEPTHS, folds: int = 5, seed: int = 101,
) -> tuple[TreesModel, dict[tuple[int, int], list[float]]]:
    """The forest of the best mean average precision over ``folds``, grown on all rows, and every point's measures.

    Ties go to the shallower, then the smaller forest. Each node tries the square root of the number of features. Null labels are not
    allowed; without both classes there is nothing to split and the model gives the only label's value.
    """
    binning = growth.fit_binning(df, features)
    blocks = growth.blocks(df, binning, target, F.lit(1.0), F.lit(False), features)
    positive, negative = df.select(F.count_if(F.col(target) > 0), F.count_if(F.col(target) <= 0)).first()
    fewer = min(positive, negative) or 1
    rates = (min(1.0, fewer / max(negative, 1)), min(1.0, fewer / max(positive, 1)))
    forest = Forest(blocks, binning, max(counts), folds, rates, seed)
    forest.grow(max(depths))
    measures = forest.average_precisions(tuple(counts), tuple(depths))
    best = max(measures, key=lambda p: (np.mean(measures[p] or [0.0]), -p[1], -p[0]))
    own = forest.trees[forest.each * folds:][:best[0]]
    return TreesModel.of(own, binning, "mean", features, best[1]), measures
