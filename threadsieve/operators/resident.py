"""Training rows that one task holds: histograms of several levels and rounds from cells kept in memory.

A row is kept as its cells other than zero, by row for the histograms and by feature for the splits. Of two children the one of fewer rows
is added up, the other is the parent less it. Sums of gradients are exact, so the splits are those of a pass over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from threadsieve.operators import growth
from threadsieve.operators.growth import BINS, Block, Tree


class Rows:
    """One block: ``code`` holds ``feature * BINS + bin`` of each cell other than zero, row by row from ``first``."""

    def __init__(self, block: Block, zero: np.ndarray):
        n, width = block.x.shape
        row, feature = np.nonzero(block.x != zero)
        bins = block.x[row, feature]
        self.code = (feature * BINS + bins).astype(np.int32)
        self.first = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
        order = np.argsort(feature.astype(np.uint16) if width <= 1 << 16 else feature, kind="stable")
        self.by_row, self.by_bin = row[order].astype(np.int32), bins[order]
        self.by_first = np.append(0, np.cumsum(np.bincount(feature, minlength=width)))
        self.number, self.y, self.w, self.held = block.number, block.y, block.w, block.held
        self.margin, self.keys = block.margin, None
        self.node = np.zeros(n, np.int64)

    def grown(self, rows: float, *seed: int) -> np.ndarray:
        if rows >= 1:
            return ~self.held
        if self.keys is None:
            self.keys = growth.hashed(self.number, np.arange(len(self.y)))
        return ~self.held & (growth.uniform(self.keys, *seed) < rows)

    def split(self, node: int, feature: int, bin_: int, left: int, zero: np.ndarray) -> None:
        """Rows of ``node`` move to its children."""
        right = np.full(len(self.node), zero[feature] > bin_)
        own = slice(self.by_first[feature], self.by_first[feature + 1])
        right[self.by_row[own]] = self.by_bin[own] > bin_
        at = np.flatnonzero(self.node == node)
        self.node[at] = left + right[at]

    def add_up(self, slot: np.ndarray, g: np.ndarray, h: np.ndarray, sums: np.ndarray) -> None:
        """Add the cells of rows of a slot to ``sums[0]`` and ``sums[1]``, by (slot, feature, bin)."""
        some = np.flatnonzero(slot >= 0)
        each = self.first[some + 1] - self.first[some]
        ends = np.cumsum(each)
        if not len(ends) or not ends[-1]:
            return
        at = self.code if len(some) == len(slot) else self.code[np.arange(ends[-1]) + np.repeat(self.first[some] - ends + each, each)]
        size = sums[0][0].size
        at = at + np.repeat(slot[some] * size, each)
        for out, v in zip(sums, (g, h)):
            out += np.bincount(at, np.repeat(v[some], each), out.size).reshape(out.shape)


class Resident:
    """The rows of all ``blocks``; ``look`` is called level by level and tree by tree, as in a pass over tasks."""

    def __init__(self, blocks: Iterable[Block], zero: np.ndarray, options, margin, loss_sums, measured):
        self.zero, self.options, self.loss_sums, self.measured = zero, options, loss_sums, measured
        self.rows, self.sums, self.moved = [], {}, 0
        for block in blocks:
            rows = Rows(block, zero)
            rows.margin = margin(block)
            self.rows.append(rows)
        self.rows.sort(key=lambda r: r.number)

    def begin(self, number: int) -> None:
        o = self.options
        self.sums, self.moved = {}, 0
        for rows in self.rows:
            p = 1.0 / (1.0 + np.exp(-rows.margin))
            rows.g, rows.h = growth.exact(rows.w * (p - rows.y)), growth.exact(rows.w * p * (1 - p))
            rows.counted = rows.grown(o.rows, o.seed, number // o.rows_every)
            rows.node[:] = 0

    def move(self, tree: Tree) -> None:
        """Rows go down the splits made since the last call."""
        made = [n for n in range(len(tree.left)) if tree.left[n] > self.moved]
        for rows in self.rows:
            for node in made:
                rows.split(node, tree.feature[node], tree.bin[node], tree.left[node], self.zero)
        self.moved = len(tree.left) - 1

    def end(self, tree: Tree) -> None:
        self.move(tree)
        value = np.array(tree.value)
        for rows in self.rows:
            rows.margin = rows.margin + value[rows.node]

    def loss(self) -> float:
        o, losses = self.options, 0.0
        for rows in self.rows:
            losses = losses + self.loss_sums(o.metric, rows.y[rows.held], rows.w[rows.held], rows.margin[rows.held])
        total = losses + np.zeros(1)
        return self.measured(o.metric, total) if len(total) > 1 else 0.0

    def look(self, number: int, tree: Tree, frontier: list[int], measure: bool) -> list[dict]:
        """The best split of each node of the frontier; with ``measure`` also a row of slot -1 with the loss."""
        o, width = self.options, len(self.zero)
        if frontier == [0]:
            self.begin(number)
        self.move(tree)
        parent = {c: n for n in range(len(tree.left)) if tree.left[n] >= 0 for c in (tree.left[n], tree.left[n] + 1)}
        size = np.zeros(len(tree.left), np.int64)
        for rows in self.rows:
            size += np.bincount(rows.node[rows.counted], minlength=len(size))
        other = {c: tree.left[parent[c]] + (c == tree.left[parent[c]]) for c in frontier if c in parent}
        added = [c for c in frontier if c not in other or (size[c], c) < (size[other[c]], other[c])]
        slots = np.full(len(tree.left), -1)
        slots[added] = np.arange(len(added))
        sums, totals = np.zeros((2, len(added), width, BINS)), np.zeros((2, len(added)))
        for rows in self.rows:
            slot = np.where(rows.counted, slots[rows.node], -1)
            rows.add_up(slot, rows.g, rows.h, sums)
            some = slot >= 0
            totals += [np.bincount(slot[some], v[some], len(added)) for v in (rows.g, rows.h)]
        sums[:, :, np.arange(width), self.zero] = totals[:, :, None] - sums.sum(axis=3)
        new = {c: sums[:, i] for i, c in enumerate(added)}
        for c in frontier:
            if c not in new:
                new[c] = self.sums[parent[c]] - new[other[c]]
        self.sums = new
        take = np.sort(np.argsort(growth.hashed(o.seed, number, np.arange(width)))[:max(1, round(o.features * width))])
        found = []
        for slot, c in enumerate(frontier):
            for _, f, b, gain, *rest in growth.best_splits(np.moveaxis(new[c][:, take], 0, -1)[None], o.penalty, o.least):
                found.append(dict(zip(("slot", "feature", "bin", "gain", "g", "h", "gl", "hl"),
                                      (slot, int(take[f]), int(b), float(gain), *map(float, rest)))))
        if measure:
            found.append({"slot": -1, "gain": self.loss()})
        return found
