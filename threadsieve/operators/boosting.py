"""Boosted trees whose training can stop and go on.

Every row keeps its margin beside it. A round grows one tree on the gradient of the log loss; the pass that begins a round also
measures, on the validation rows, the rounds before it. Training ends a number of rounds after the best one and keeps the
trees up to it. From time to time margins, trees and measures are written; training with the same folder goes on from there and
gives the same trees. Rows whose cells a task can hold are trained on in one task, which reads them once for all rounds between
two writings; more of them are read in a pass of all tasks for each level. Both give the same trees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.operators import growth
from threadsieve.operators.growth import Binning, Tree, TreesModel, exact
from threadsieve.operators.resident import Resident
from threadsieve.session import scratch_path, setting

# Rounds between two writings of the margins.
KEEP_EVERY = 32
# Blocks whose margins a Python process keeps: 32 KB each.
MARGINS_KEPT = 2048
# Cells other than zero, about 10 bytes each, and numbers of a level's histograms that a single task holds.
CELLS_IN_TASK, SUMS_IN_TASK = 32_000_000, 1 << 23
# A task that holds all rows reads them in batches of a few blocks; Spark's 64 MB would lie in the executor and the Python worker beside them.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
LEVELS = 1 << 16


@dataclass
class Options:
    rounds: int = 1000
    depth: int = 5
    step: float = 0.1
    patience: int = 50
    metric: str = "logloss"  # or auc, average_precision
    rows: float = 1.0
    rows_every: int = 1
    features: float = 1.0
    penalty: float = 1.0
    least: float = 1.0
    seed: int = 101


# The three trainings of the reference, by their stop metric.
PRESETS = {
    "auc": Options(metric="auc", depth=6, step=2e-5, penalty=3.0),
    "average_precision": Options(metric="average_precision", depth=5, step=0.05, features=0.9, rows=0.8, rows_every=5, penalty=0.0),
    "logloss": Options(metric="logloss", depth=6, step=0.3, rows=0.8, features=0.8),
}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


# Margins that a Python process has made, by training and block, each with its number of trees; a process without them makes them again.
_MADE: dict[tuple[str, int], tuple[int, np.ndarray]] = {}


def margins(block: growth.Block, pending: list[Tree], written: int = 0, training: str = "") -> np.ndarray:
    """Margins of the ``written`` trees that the block holds and the ``pending`` ones; with a ``training`` only new trees are walked."""
    done, margin = _MADE.get((training, block.number), (0, block.margin))
    if not written <= done <= written + len(pending):
        done, margin = written, block.margin
    for tree in pending[done - written:]:
        margin = margin + np.array(tree.value)[tree.walk(block.x)]
    if training:
        if len(_MADE) >= MARGINS_KEPT or (_MADE and next(iter(_MADE))[0] != training):
            _MADE.clear()
        _MADE[training, block.number] = written + len(pending), margin
    return margin


def measured(metric: str, sums: np.ndarray) -> float:
    """A loss, the lower the better: log loss, or 1 minus an area, from sums over levels of the probability."""
    if metric == "logloss":
        return float(sums[0] / sums[1]) if sums[1] else 0.0
    negative, positive = sums.reshape(2, LEVELS)[:, ::-1]
    tp, fp = np.cumsum(positive), np.cumsum(negative)
    if not tp[-1]:
        return 1.0
    if metric == "auc":
        return 1.0 - float((negative * (tp - positive / 2)).sum() / (tp[-1] * fp[-1])) if fp[-1] else 1.0
    here = positive > 0
    return 1.0 - float((positive[here] * tp[here] / (tp + fp)[here]).sum() / tp[-1])


def loss_sums(metric: str, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> np.ndarray:
    if metric == "logloss":
        return np.array([exact(w * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum(), w.sum()])
    level = np.rint(sigmoid(margin) * (LEVELS - 1)).astype(np.int64)
    return np.bincount(level + LEVELS * (y > 0), minlength=2 * LEVELS).astype(float)


def best_round(losses: list[float], trees: list[Tree]) -> int:
    """Rounds up to the lowest loss, the first of equal ones."""
    return 1 + int(np.argmin(losses)) if losses else len(trees)


def is_over(losses: list[float], patience: int) -> bool:
    return bool(losses) and len(losses) - best_round(losses, []) >= patience


def grow(trees: list[Tree], losses: list[float], options: Options, validated: bool, look: Callable[[Tree, list[int], bool], list]) -> bool:
    """One more tree, unless the rounds before it tell to end; ``look`` gives the best splits of a frontier."""
    def leaf(g: float, h: float) -> float:
        bottom = h + options.penalty
        return -options.step * g / bottom if bottom > 0 else 0.0

    tree, frontier = Tree(), [0]
    for level in range(options.depth):
        rows = look(tree, frontier, level == 0 and validated)
        if level == 0 and validated and trees:
            losses.append(next(r["gain"] for r in rows if r["slot"] < 0))
            if is_over(losses, options.patience):
                return False
        following = []
        for slot, node in enumerate(frontier):
            best = max((r for r in rows if r["slot"] == slot), key=lambda r: (r["gain"], -r["feature"]), default=None)
            if best is None:
                continue
            if node == 0:
                tree.value[0] = leaf(best["g"], best["h"])
            if best["gain"] > 1e-9:
                g, h = best["g"] - best["gl"], best["h"] - best["hl"]
                following += tree.split(node, best["feature"], best["bin"], (leaf(best["gl"], best["hl"]), leaf(g, h)))
        frontier = following
        if not frontier:
            break
    trees.append(tree)
    return True


class Booster:
    def __init__(self, blocks: DataFrame, binning: Binning, options: Options, validated: bool, folder: str):
        self.blocks, self.binning, self.options, self.validated, self.folder = blocks, binning, options, validated, folder
        self.partitions = blocks.rdd.getNumPartitions()
        self.trees: list[Tree] = []
        self.written = 0  # trees that the stored margins hold
        self.losses: list[float] = []
        self.name = uuid.uuid4().hex
        self.resident: bool | None = None

    def _pass(self, tree: Tree, frontier: list[int], measure: bool) -> list:
        """Best splits of the frontier, a row per node and part of the features; with ``measure`` also a row of slot -1 with the loss."""
        o, zero, width = self.options, self.binning.zero, len(self.binning.thresholds)
        pending, number = self.trees[self.written:], len(self.trees)
        take = np.sort(np.argsort(growth.hashed(o.seed, number, np.arange(width)))[:max(1, round(o.features * width))])
        parts = [take[i:i + growth.FEATURES_AT_ONCE] for i in range(0, len(take), growth.FEATURES_AT_ONCE)]
        metric, k, written, name = o.metric, len(frontier), self.written, self.name
        slots = np.full(len(tree.left), -1)
        slots[frontier] = np.arange(k)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, losses = np.zeros((k, len(take), growth.BINS, 2)), 0.0
            for block in growth.read_blocks(batches, width):
                margin = margins(block, pending, written, name)
                grown = ~block.held
                if o.rows < 1:
                    grown &= growth.uniform(block.keys, o.seed, number // o.rows_every) < o.rows
                p = sigmoid(margin)
                g, h = exact(block.w * (p - block.y)), exact(block.w * p * (1 - p))
                slot = np.where(grown, slots[tree.walk(block.x)], -1)
                x = block.x if len(take) == width else np.ascontiguousarray(block.x[:, take])
                sums += growth.histogram(x, slot, k, g, h, zero[take])
                if measure:
                    losses = losses + loss_sums(metric, block.y[block.held], block.w[block.held], margin[block.held])
            ends = np.cumsum([len(some) for some in parts])[:-1]
            rows = [(0, i, k, s.shape[1], s.tobytes()) for i, s in enumerate(np.split(sums, ends, axis=1))]
            if measure:
                rows.append((-1, -1, 1, 1, (losses + np.zeros(1)).tobytes()))
            types = [pa.int32()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["tree", "part", "k", "m", "hist"])

        def judge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            tree_, part = (x.as_py() for x in key)
            total = sum(np.frombuffer(cell.as_buffer(), "<f8") for cell in group["hist"])
            if tree_ < 0:
                return growth.found_splits([(-1, -1, 0, 0, measured(metric, total) if len(total) > 1 else 0.0, 0.0, 0.0, 0.0, 0.0)])
            hist = total.reshape(k, len(parts[part]), growth.BINS, 2)
            return growth.found_splits([(0, s, parts[part][f], b, *rest) for s, f, b, *rest in growth.best_splits(hist, o.penalty, o.least)])

        size = self.partitions * (k * len(take) * growth.BINS * 16 + (0 if metric == "logloss" else 16 * LEVELS))
        return growth.settled(self.blocks.mapInArrow(add_up, growth.PART), judge, growth.SPLITS, size)

    def fits(self) -> bool:
        """Whether one task can hold the cells of all blocks."""
        width, zero = len(self.binning.thresholds), self.binning.zero

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in growth.read_blocks(batches, width):
                yield pa.RecordBatch.from_pydict({"cells": pa.array([np.count_nonzero(block.x != zero) + len(block.y)], pa.int64())})

        if width * growth.BINS * 2 << self.options.depth - 1 > SUMS_IN_TASK:
            return False
        return (self.blocks.mapInArrow(count, "cells long").agg(F.sum("cells")).first()[0] or 0) <= CELLS_IN_TASK

    def _grow(self, limit: int) -> bool:
        """More trees, ``limit`` in all at most, until the rounds tell to end."""
        if self.resident is None:
            self.resident = self.fits()
        if not self.resident:
            return grow(self.trees, self.losses, self.options, self.validated, self._pass)
        options, validated, zero, width = self.options, self.validated, self.binning.zero, len(self.binning.thresholds)
        before, losses, written, limit = self.trees, self.losses, self.written, min(limit, self.written + KEEP_EVERY)

        def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, measures, more = list(before), list(losses), True
            held = Resident(growth.read_blocks(batches, width), zero, options, lambda block: margins(block, before[written:]), loss_sums, measured)
            while more and len(trees) < limit:
                more = grow(trees, measures, options, validated, lambda tree, frontier, measure: held.look(len(trees), tree, frontier, measure))
                if more:
                    held.end(trees[-1])
            told = json.dumps([[asdict(t) for t in trees[len(before):]], measures[len(losses):], more])
            yield pa.RecordBatch.from_pydict({"told": [told]})

        with setting(self.blocks.sparkSession, BATCH, str(BATCH_BYTES), replace=False):
            told = self.blocks.coalesce(1).mapInArrow(rounds, "told string").first()[0]
        trees, measures, more = json.loads(told)
        self.trees = self.trees + [Tree(**t) for t in trees]
        self.losses = self.losses + measures
        return more

    def best(self) -> int:
        return best_round(self.losses, self.trees)

    def ended(self) -> bool:
        return is_over(self.losses, self.options.patience)

    def _write(self) -> None:
        """Margins of all trees so far, and what tells how to go on."""
        pending, width = self.trees[self.written:], len(self.binning.thresholds)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [margins(block, pending).tobytes() for block in growth.read_blocks(iter([batch]), width)]
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(new, pa.binary()))

        spark = self.blocks.sparkSession
        path = f"{self.folder}/margins-{len(self.trees):06d}"
        self.blocks.mapInArrow(move, growth.BLOCK).write.mode("overwrite").parquet(path)
        self.blocks, self.written = spark.read.schema(growth.BLOCK).parquet(path), len(self.trees)
        state = {"rounds": len(self.trees), "trees": [asdict(t) for t in self.trees], "losses": self.losses, "blocks": path,
                 "thresholds": self.binning.thresholds, "options": asdict(self.options), "validated": self.validated}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{self.folder}/state/rounds={len(self.trees)}")

    def run(self, rounds: int | None = None) -> TreesModel:
        """Train to the end, or at most up to ``rounds``; what is there by then is written."""
        limit = min(self.options.rounds, rounds or self.options.rounds)
        while len(self.trees) < limit and not self.ended() and self._grow(limit):
            if len(self.trees) - self.written >= KEEP_EVERY or len(self.trees) == rounds:
                self._write()
        if self.validated and self.trees and not self.ended() and len(self.losses) < len(self.trees):
            self.losses.append(next(r["gain"] for r in self._pass(Tree(), [0], measure=True) if r["slot"] < 0))
        kept = self.trees[:self.best()] if self.validated else self.trees
        return TreesModel.of(kept, self.binning, "logistic")


def resume(spark, folder: str) -> Booster | None:
    """The training last written to ``folder``, or None."""
    try:
        rows = spark.read.text(f"{folder}/state").orderBy(F.desc("rounds")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return None
        raise
    state = json.loads(rows[0].value)
    blocks = spark.read.schema(growth.BLOCK).parquet(state["blocks"])
    booster = Booster(blocks, Binning(state["thresholds"]), Options(**state["options"]), state["validated"], folder)
    booster.trees, booster.written = [Tree(**t) for t in state["trees"]], state["rounds"]
    # the measure of the last round is taken again when the next one begins
    booster.losses = state["losses"]
    return booster


def boosted(
    df: DataFrame, features: str = "features", target: str = "target", weight: str = "weight", validation: str | None = None,
    options: Options | str = "logloss", folder: str | None = None, pause: int | None = None, **changed,
) -> TreesModel:
    """Train boosted trees on weighted rows; rows of a true ``validation`` are only measured.

    ``options`` are the values of a training or the name of a preset, ``changed`` replaces single ones. With a ``folder`` of an earlier
    training this goes on with it and reads neither ``df`` nor options; ``pause`` ends a call after that many rounds, before the training's own end. A null validation
    mark is false, null labels and weights are not allowed. Without any row the model gives 0.5.
    """
    spark = df.sparkSession
    booster = resume(spark, folder) if folder else None
    if booster is None:
        values = Options(**(asdict(PRESETS[options] if isinstance(options, str) else options) | changed))
        held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
        binning = growth.fit_binning(df.where(~held), features)
        blocks = growth.blocks(df, binning, target, F.col(weight), held, features)
        validated = bool(validation) and not df.where(held).isEmpty()
        booster = Booster(blocks, binning, values, validated, folder or scratch_path(spark, "boosting"))
    return booster.run(pause)._set(featuresCol=features)
