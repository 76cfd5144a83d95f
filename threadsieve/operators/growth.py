"""Growing binary trees from feature histograms, level by level, all trees of a call together.

Training rows lie in blocks: a matrix of bin numbers and a few numeric columns, each one binary cell, written once. A pass over the
blocks adds up gradients and weights by (tree, node, feature, bin) in every task, sums them by tree and part of the features
in a shuffle, and returns one best split per node and part; the driver sees these alone. Gradients are multiples of 2**-20,
so their sums are exact and the trees do not depend on the order or the partitioning of the rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadsieve.session import store

BINS = 16
BLOCK_ROWS = 4096
# Bytes of bin numbers per partition, features per part of a shuffle, histogram cells that a task holds at once.
PARTITION_BYTES, FEATURES_AT_ONCE, CELLS_AT_ONCE = 32 << 20, 256, 1 << 24
# Nodes whose features are drawn together, so that the ranks stay in a processor's cache.
NODES_AT_ONCE = 64
# Bytes of histograms, from all tasks together, that the driver adds up itself.
DRIVER_BYTES = 16 << 20
EXACT = float(1 << 20)
BLOCK = "block long, n int, x binary, y binary, w binary, held binary, margin binary"
PART = "tree int, part int, k int, m int, hist binary"
BEST = [("tree", "int32"), ("slot", "int32"), ("feature", "int32"), ("bin", "int32"), *[(c, "float64") for c in ("gain", "g", "h", "gl", "hl")]]
NO_SPLIT = 1.7976931348623157e308


def exact(x: np.ndarray) -> np.ndarray:
    return np.rint(x * EXACT) / EXACT


def hashed(*parts) -> np.ndarray:
    """64-bit hash of whole numbers, elementwise over arrays."""
    h = np.uint64(0x2545F4914F6CDD1D)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
            h = h ^ (h >> np.uint64(29))
    return h


def uniform(*parts) -> np.ndarray:
    return (hashed(*parts) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Tree:
    """Nodes in order of growth; ``left`` of a leaf is -1, the right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    level: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int, values: tuple[float, float]) -> list[int]:
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, len(self.left)
        for value in values:
            self.feature.append(0)
            self.bin.append(0)
            self.left.append(-1)
            self.value.append(value)
            self.level.append(self.level[node] + 1)
        return [len(self.left) - 2, len(self.left) - 1]

    def walk(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node of each row, at most ``depth`` levels down."""
        feature, bin_, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        node, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(max(self.level) if depth is None else depth):
            on = left[node] >= 0
            if not on.any():
                break
            node = np.where(on, left[node] + (x[row, feature[node]] > bin_[node]), node)
        return node


def cells(features: str) -> tuple[Column, Column]:
    """Indices and values of a sparse or dense vector column."""
    parts = F.unwrap_udt(F.col(features))
    size = F.size(parts["values"])
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(parts["indices"], every), parts["values"]


@dataclass
class Binning:
    """Ascending thresholds of each feature; a value's bin is the number of thresholds below it."""

    thresholds: list[list[float]]

    @property
    def zero(self) -> np.ndarray:
        return np.array([np.searchsorted(t, 0.0) for t in self.thresholds], np.uint8)


def fit_binning(df: DataFrame, features: str = "features", bins: int = BINS) -> Binning:
    """Zero and the quantiles of each feature's other values, counted over all rows; one row per feature reaches the driver."""
    indices, values = cells(features)
    size = df.select(F.max(F.coalesce(F.unwrap_udt(F.col(features))["size"], F.size(values)))).first()[0] or 1
    each = df.select(F.explode(F.arrays_zip(indices.alias("i"), values.alias("v"))).alias("c")).select("c.*").where("v <> 0")
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    found = each.groupBy("i").agg(F.percentile_approx("v", shares, 10_000).alias("t")).collect()
    thresholds = [[0.0] for _ in range(size)]
    for r in found:
        thresholds[r.i] = sorted({0.0, *r.t})
    return Binning(thresholds)


def blocks(df: DataFrame, binning: Binning, y: str, w: Column, held: Column, features: str = "features") -> DataFrame:
    """The rows in stored blocks: bins, label, weight, whether it is held out of growth, and a margin of 0."""
    n = df.count()
    indices, values = cells(features)
    rows = df.select(indices.alias("i"), values.alias("v"), F.col(y).cast("double").alias("y"), w.cast("double").alias("w"),
                     held.cast("boolean").alias("held"))
    width = max(len(binning.thresholds), 1)
    parts = max(1, -(-n * width // PARTITION_BYTES))
    rows = rows.coalesce(parts) if parts < rows.rdd.getNumPartitions() else rows.repartition(parts)
    thresholds, zero = [np.array(t) for t in binning.thresholds], binning.zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for whole in batches:
            for batch in [whole.slice(at, BLOCK_ROWS) for at in range(0, len(whole), BLOCK_ROWS)]:
                column, value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "v"))
                row = np.repeat(np.arange(len(batch)), batch.column("i").value_lengths().to_numpy(zero_copy_only=False))
                x = np.tile(zero, (len(batch), 1))
                order = np.argsort(column, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(column[order]) > 0)) if len(order) else []
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    these = order[a:b]
                    x[row[these], column[these[0]]] = np.searchsorted(thresholds[column[these[0]]], value[these])
                numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("y", "<f8"), ("w", "<f8"), ("held", "u1"))]
                yield pa.RecordBatch.from_pydict({
                    "block": [number], "n": pa.array([len(batch)], pa.int32()), "x": [x.tobytes()], "y": [numbers[0].tobytes()],
                    "w": [numbers[1].tobytes()], "held": [numbers[2].tobytes()], "margin": [bytes(8 * len(batch))]})
                number += 1

    return store(rows.mapInArrow(run, BLOCK), "blocks")


@dataclass
class Block:
    number: int
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    margin: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return hashed(self.number, np.arange(len(self.y)))


def read_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(len(batch)):
            cell = {c: batch.column(c)[i] for c in batch.schema.names}
            number = lambda c, t: np.frombuffer(cell[c].as_buffer(), t)  # noqa: E731, B023
            yield Block(cell["block"].as_py(), number("x", np.uint8).reshape(-1, width), number("y", "<f8"), number("w", "<f8"),
                        number("held", "u1").astype(bool), number("margin", "<f8"))


def totals_of(slot: np.ndarray, k: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(slot, g, k), np.bincount(slot, h, k)], axis=-1)


def histogram(x: np.ndarray, slot: np.ndarray, k: int, g: np.ndarray, h: np.ndarray, zero: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Sums by (node, feature, bin) over all features; rows of slot -1 do not count. Cells that hold a zero are not visited."""
    width = x.shape[1]
    some = slot >= 0
    full = np.flatnonzero((x != zero).ravel())
    row = full // width if len(full) >= 1 << 31 else (full.astype(np.uint32) // np.uint32(width)).astype(np.int64)
    # (node, feature) as one number: the cell's place moved from its row to its row's node
    shift = (slot - np.arange(len(x))) * width
    at = (full + shift[row]) * bins + x.ravel()[full]
    if not some.all():
        counted = some[row]
        row, at = row[counted], at[counted]
    out = np.empty((k, width, bins, 2))
    zeros = np.arange(width), zero
    for i, v in enumerate((g, h)):
        sums = np.bincount(at, v[row], k * width * bins).reshape(k, width, bins)
        sums[:, *zeros] = np.bincount(slot[some], v[some], k)[:, None] - sums.sum(axis=2)
        out[..., i] = sums
    return out


def chosen_features(seed: int, tree: int, nodes: list[int], width: int, m: int) -> np.ndarray:
    """``m`` features for each node, the same in every task."""
    out = []
    for at in range(0, len(nodes), NODES_AT_ONCE):
        rank = hashed(seed, tree, np.array(nodes[at:at + NODES_AT_ONCE])[:, None], np.arange(width)[None, :])
        out.append(np.sort(np.argpartition(rank, min(m, width) - 1, axis=1)[:, :m], axis=1))
    return np.concatenate(out)


def histogram_of(x: np.ndarray, slot: np.ndarray, features: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Sums by (node, place in its own features, bin)."""
    k, m = features.shape
    some = np.flatnonzero(slot >= 0)
    at = (slot[some, None] * m + np.arange(m)) * bins + x[some[:, None], features[slot[some]]]
    return np.stack([np.bincount(at.ravel(), np.repeat(v[some], m), k * m * bins).reshape(k, m, bins) for v in (g, h)], axis=-1)


def best_splits(hist: np.ndarray, penalty: float, least: float) -> list[tuple]:
    """``(slot, place, bin, gain, g, h, gl, hl)`` of each node: the first of the highest gains."""
    total = hist[:, :1].sum(axis=2)[:, 0]
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    right = total[:, None, None] - left

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.where(s[..., 1] + penalty > 0, s[..., 1] + penalty, np.inf)

    gain = worth(left) + worth(right) - worth(total)[:, None, None]
    gain[(left[..., 1] < least) | (right[..., 1] < least)] = -1.0
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    place, bin_ = np.divmod(at, gain.shape[2])
    node = np.arange(len(gain))
    return list(zip(node, place, bin_, flat[node, at], total[:, 0], total[:, 1], left[node, place, bin_, 0], left[node, place, bin_, 1]))


def settled(parts: DataFrame, judge: Callable[[tuple, pa.Table], pa.Table], schema: str, size: int) -> list[dict]:
    """``judge`` of the rows of each ``tree, part``: in a shuffle, or on the driver if ``size``, a bound on all rows' bytes, is small."""
    if size > DRIVER_BYTES:
        return parts.groupBy("tree", "part").applyInArrow(judge, schema).toArrow().to_pylist()
    table = parts.toArrow()
    rows = {}
    for i, key in enumerate(zip(table["tree"].to_pylist(), table["part"].to_pylist())):
        rows.setdefault(key, []).append(i)
    return [r for key, at in rows.items() for r in judge(tuple(map(pa.scalar, key)), table.take(at)).to_pylist()]


def found_splits(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(BEST)
    return pa.table({name: np.array(c).astype(kind) for (name, kind), c in zip(BEST, columns)})


SPLITS = ", ".join(f"{name} {'int' if kind == 'int32' else 'double'}" for name, kind in BEST)


def tree_sums(parts: dict) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """The sum of the trees' values, in their order, for rows given as indices and values of vectors."""
    roots, left, feature = (np.array(parts[name], np.int64) for name in ("roots", "left", "feature"))
    threshold, value = (np.array(parts[name], np.float64) for name in ("threshold", "value"))
    inner = left != np.arange(len(left))
    # only features that a node asks for are laid out
    used = np.unique(feature[inner])
    feature = np.where(inner, np.searchsorted(used, feature), 0)
    at_once = max(1, CELLS_AT_ONCE // 8 // max(len(used), 1))

    def sums(indices: pa.Array, values: pa.Array) -> pa.Array:
        if indices.null_count:
            raise ValueError("a row has no feature vector")
        out = [np.zeros(0)]
        for at in range(0, len(indices), at_once):
            i, v = indices.slice(at, at_once), values.slice(at, at_once)
            row = np.repeat(np.arange(len(i)), i.value_lengths().to_numpy(zero_copy_only=False))
            column, cell = (c.flatten().to_numpy(zero_copy_only=False) for c in (i, v))
            place = np.searchsorted(used, column)
            asked = np.flatnonzero(used[np.minimum(place, len(used) - 1)] == column) if len(used) else []
            x = np.zeros((len(i), max(len(used), 1)))
            x[row[asked], place[asked]] = cell[asked]
            total, every = np.zeros(len(i)), np.arange(len(i))
            for root in roots:
                node = np.full(len(i), root)
                for _ in range(parts["depth"]):
                    on = inner[node]
                    if not on.any():
                        break
                    # as in Spark, NaN is above every threshold
                    node = np.where(on, left[node] + ~(x[every, feature[node]] <= threshold[node]), node)
                total += value[node]
            out.append(total)
        return pa.array(np.concatenate(out))

    return sums


class TreesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """A sum (``logistic``) or mean (``mean``) of trees over a vector column; adds ``probability`` and ``prediction``.

    Scoring walks the trees for a batch of rows at once, over the cells of each row's vector.
    """

    trees = Param(Params._dummy(), "trees", "JSON: roots, left, feature, threshold, value, depth", TypeConverters.toString)
    combine = Param(Params._dummy(), "combine", "logistic or mean", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", trees="{}", combine="logistic"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, trees: list[Tree], binning: Binning, combine: str, features: str = "features", depth: int | None = None) -> TreesModel:
        """The first ``depth`` levels of the trees; a child is at ``left`` or one after it, a leaf leads to itself."""
        out = {"roots": [], "left": [], "feature": [], "threshold": [], "value": [], "depth": 1}
        for tree in trees:
            base = len(out["left"])
            out["roots"].append(base)
            for node, left in enumerate(tree.left):
                leaf = left < 0 or (depth is not None and tree.level[node] >= depth)
                out["left"].append(base + (node if leaf else left))
                out["feature"].append(0 if leaf else tree.feature[node])
                out["threshold"].append(NO_SPLIT if leaf else binning.thresholds[tree.feature[node]][tree.bin[node]])
                out["value"].append(tree.value[node])
            out["depth"] = max(out["depth"], max(tree.level) if depth is None else min(depth, max(tree.level)))
        return cls(featuresCol=features, trees=json.dumps(out), combine=combine)

    @property
    def size(self) -> int:
        return len(json.loads(self.getOrDefault(self.trees))["roots"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = json.loads(self.getOrDefault(self.trees))
        # Python reads the cells of a vector once per row; in a native lambda the vector would be made again at every node.
        indices, values = cells(self.getFeaturesCol())
        total = F.arrow_udf(tree_sums(parts), "double")(indices, values)
        logistic = self.getOrDefault(self.combine) == "logistic"
        p = 1 / (1 + F.exp(-F.col("_total"))) if logistic else F.col("_total") / max(len(parts["roots"]), 1)
        scored = dataset.withColumn("_total", total).withColumn("_p", p)
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).withColumn(
            "prediction", (F.col("_p") > 0.5).cast("double")).drop("_total", "_p")
