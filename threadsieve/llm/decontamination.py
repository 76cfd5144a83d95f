"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

For every length of a benchmark item, windows of as many words slide over each document; a document of fewer words is one
window if its shingles can reach the wanted share of the item's. A window's fingerprint has a
bit for each of ``BITS`` random signs summed over its shingles, and two fingerprints that differ in at most ``RADIUS`` bits
agree within ``RADIUS // BLOCKS`` bits in one of ``BLOCKS`` blocks. The index holds each item under all values so near to each
of its blocks, hence it finds every item within the radius; those are compared on their weighted shingles. Windows
without any shingle of the benchmark have similarity 0 and get no fingerprint.
At similarity 0.8 bits differ with probability 0.15, and more than ``RADIUS`` of them with 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.llm.common import map_batches, spread, whole
from threadsieve.llm.words import mix, pieces, shingles, words

WORDS, BITS, BLOCKS, RADIUS = 5, 128, 8, 39
# Items that travel to the tasks at once; a larger benchmark takes more passes over the documents.
ITEMS_AT_ONCE = 2_000
_NEAR = np.array([sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS // BLOCKS), n)], np.uint16)
_SHIFTS = np.arange(64, dtype=np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    """+-1 for each shingle and bit."""
    halves = [((x[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int8) for x in (mix(h), mix(~h))]
    return np.concatenate(halves, 1) * np.int8(2) - np.int8(1)


def blocks(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as ``BLOCKS`` 16-bit numbers a row."""
    return np.packbits(sums >= 0, axis=1).view(">u2").astype(np.uint16)


class Items:
    """Benchmark items of one pass, grouped by their number of words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.by_length: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        self.prints: dict[int, np.ndarray] = {}
        self.known: dict[int, np.ndarray] = {}
        for at, (item, text) in enumerate(rows):
            for piece in pieces(pa.array([text], pa.string())):
                w = words(piece)
            n = len(w.hashes)
            if n:
                h, _ = shingles(w, min(n, WORDS))
                self.by_length.setdefault(n, []).append((item, *np.unique(h, return_counts=True), blocks(signs(h).sum(0, dtype=np.int32)[None])))
        for n, own in self.by_length.items():
            self.prints[n] = np.concatenate([x[3] for x in own])
        for size in {min(n, WORDS) for n in self.by_length}:
            self.known[size] = np.unique(np.concatenate([x[1] for n, own in self.by_length.items() if min(n, WORDS) == size for x in own]))
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``window, item`` of all pairs within the radius, found over the blocks."""
        if length not in self.index:
            own = self.prints[length].astype(np.int64)
            keys = ((own[:, :, None] ^ _NEAR.astype(np.int64)) | (np.arange(BLOCKS) << 16)[None, :, None]).reshape(len(own), -1)
            item = np.repeat(np.arange(len(own), dtype=np.int32), keys.shape[1])
            order = np.argsort(keys.ravel(), kind="stable")
            self.index[length] = keys.ravel()[order], item[order]
        keys, item = self.index[length]
        wanted = (prints.astype(np.int64) | (np.arange(BLOCKS) << 16)).ravel()
        low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        n = high - low
        window = np.repeat(np.repeat(np.arange(len(prints)), BLOCKS), n)
        found = item[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        pair = np.unique(window * len(self.prints[length]) + found)
        window, found = pair // len(self.prints[length]), pair % len(self.prints[length])
        apart = np.bitwise_count(prints[window] ^ self.prints[length][found]).sum(1)
        return window[apart <= RADIUS], found[apart <= RADIUS]


def similarity(window: np.ndarray, item: np.ndarray, counts: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    own, n = np.unique(window, return_counts=True)
    place = np.minimum(np.searchsorted(item, own), len(item) - 1)
    common = np.minimum(n, np.where(item[place] == own, counts[place], 0)).sum()
    return float(common / (len(window) + counts.sum() - common))


def find(piece, items: Items, least: float) -> list[tuple[int, int, float, int, int]]:
    """``text, item, similarity, start, end`` (bytes in the text): the best window of each item in each text, if similar enough."""
    w = words(piece)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for size, known in items.known.items():
        h, at = shingles(w, size)
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[place] == h
        hits = np.zeros(len(h) + 1, np.int64)
        np.cumsum(hit, out=hits[1:])
        for text in np.unique(w.text[at[hit]]):
            # shingles of this text
            a, z = np.searchsorted(w.text[at], [text, text + 1])
            for length, own in items.by_length.items():
                # a shorter text is one window
                full = length - size + 1
                n = min(full, z - a)
                if min(length, WORDS) != size or n / full < least:
                    continue
                start = np.arange(a, z - n + 1)
                start = start[hits[start + n] > hits[start]]
                # a stretch of windows at a time, so that a very long text needs no more memory
                for some in np.array_split(start, max(1, len(start) // 4096)):
                    if not len(some):
                        continue
                    low, high = some[0], some[-1] + n
                    sums = np.zeros((high - low + 1, BITS), np.int32)
                    np.cumsum(signs(h[low:high]), axis=0, out=sums[1:])
                    window, item = items.near(length, blocks(sums[some - low + n] - sums[some - low]))
                    for s, i in zip(some[window], item, strict=True):
                        value = similarity(h[s : s + n], own[i][1], own[i][2])
                        if value >= least and value > best.get((text, own[i][0]), (0.0,))[0]:
                            shift = piece.offsets[text]
                            best[text, own[i][0]] = value, int(w.starts[at[s]] - shift), int(w.ends[at[s + n - 1] + size - 1] - shift)
    return [(int(t), i, *v) for (t, i), v in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def _passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark, in blocks of bounded size ordered by id."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = rows.count()
    parts = max(1, -(-total // ITEMS_AT_ONCE))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts if parts > 1 else 1))
    for i in range(2 * parts if parts > 1 else 1):
        block = [tuple(r) for r in rows.where(part == i).orderBy("item_id", "text").collect()]
        if block:
            yield block


def matches(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id, item_id, similarity, start, end``: each item that a window of a document repeats, with its best window.

    Takes ``doc_id, text`` and ``item_id, text``; other columns are ignored. ``start`` and ``end`` are character offsets of the
    window in the text. Items and texts without words match nothing; an item of fewer than five words is one shingle and
    matches only itself. Of equal similarities the first window counts. Repeated rows match alike.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = "doc_id long, item_id long, similarity double, start long, `end` long"
    out = None
    for block in _passes(items):
        def run(batches: Iterator[pa.RecordBatch], sent=rows.sparkSession.sparkContext.broadcast(block)) -> Iterator[pa.RecordBatch]:
            own = Items(sent.value)
            for batch in batches:
                for piece in pieces(batch.column("text")):
                    ids = batch.column("doc_id").slice(piece.first, len(piece))
                    found = find(piece, own, least)
                    spans = []
                    for t, _, _, a, z in found:
                        text = piece.data[piece.offsets[t] : piece.offsets[t] + z]
                        before = int(((text[:a] & 0xC0) != 0x80).sum())
                        spans.append((before, before + int(((text[a:] & 0xC0) != 0x80).sum())))
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.float64()), pa.array([s[0] for s in spans], pa.int64()),
                        pa.array([s[1] for s in spans], pa.int64())], names=["doc_id", "item_id", "similarity", "start", "end"])

        found = map_batches(rows, run, schema)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents, with all their columns, that repeat no item. Null and empty texts stay."""
    for block in _passes(items):
        def run(batches: Iterator[pa.RecordBatch], sent=docs.sparkSession.sparkContext.broadcast(block)) -> Iterator[pa.RecordBatch]:
            own = Items(sent.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for piece in pieces(batch.column("text")):
                    for found in find(piece, own, least):
                        keep[piece.first + found[0]] = False
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(keep))], names=["row"])

        rows = spread(docs).select(whole(docs).alias("row"), "text")
        docs = map_batches(rows, run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
    return docs
