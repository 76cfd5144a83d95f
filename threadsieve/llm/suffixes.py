"""Repeated substrings by a column-wise collection Burrows-Wheeler transform with common prefixes.

Which 400-byte strings start at two places? Every such string holds an anchor: the 128 bytes of least hash among its own, the
first if equal (long enough that few texts share one by chance). So each place belongs to the stretch of places with the same anchor, and equal strings
lie in stretches of equal anchors. Stretches of equal content are counted in one aggregate; nothing more is needed for the bulk of all
copies. Stretches that share an anchor but differ are split into blocks of ``BLOCK`` places at fixed distances from the
anchor. All strings of a block share a core, so only blocks of equal cores can hold equal strings, and of each such block
only the ends around the core are left to compare, the core standing as one symbol. These short strings are the
collection whose transform is built: each round inserts one symbol of every string, from the last to
the first, into the transform and the array of common prefixes. Two neighbours with a common prefix of ``BLOCK``
symbols are a repeat. A collection is bounded and its arrays are read from front to back once a round, so they lie in memory instead of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.llm.common import digest, spread
from threadsieve.llm.words import mix, pieces
from threadsieve.session import store

LENGTH, GRAM = 400, 128
# Places in a block; symbols of strings whose transform is built together; strings of one core from which on places are counted instead.
BLOCK, COLLECTION, MOST = 32, 1 << 17, 200_000
_BASE = 0x9E3779B97F4A7C15


def _slide_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` entries."""
    have = 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    rest = width - have
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``text, anchor hash, anchor, first place, last place`` of each stretch; places are offsets into ``data``."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    h, have = mix(data.astype(np.uint64) + np.uint64(1)), 1
    while have < GRAM:
        h = h[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:]
        have *= 2
    h = mix(h)
    place = np.arange(len(h), dtype=np.uint64)
    least = _slide_least((h & np.uint64(0xFFFFFFFF00000000)) | place, length - GRAM + 1) & np.uint64(0xFFFFFFFF)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    valid = np.arange(len(least)) + length <= offsets[1:][text]
    at = np.flatnonzero(valid)
    least = least[at].astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return text[at[first]], h[least[first]], least[first], at[first], at[last]


def _anchor(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                text, anchor, place, first, last = stretches(piece.data, piece.offsets, length)
                own = [xxhash.xxh3_64_intdigest(piece.data[a : z + length]) for a, z in zip(first, last, strict=True)]
                doc = batch.column("doc").slice(piece.first, len(piece)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(np.array(own, np.uint64).view(np.int64)), doc,
                    pa.array(first - piece.offsets[text]), pa.array((last - first).astype(np.int32)), pa.array((place - first).astype(np.int32)),
                ], names=["anchor", "stretch", "doc", "first", "more", "lead"])
    return run


def transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Collection Burrows-Wheeler transform (0: start of a string, else symbol) and common prefixes of neighbours.

    Round j inserts the j-th symbol from the end of every string that has one. The suffixes that the symbols make
    stand in the order of (symbol, rank of the suffix behind), the stable order of the transform so far; the common prefix of two neighbours is
    one more than the least between the suffixes behind, if the symbol is the same. Both arrays are read and written from front to
    back once per round.
    """
    m, lengths = len(strings), np.array([len(s) for s in strings])
    used, code = np.unique(np.concatenate([*strings, np.zeros(0, np.int64)]), return_inverse=True)
    code = (code + 1).astype(np.uint8 if len(used) < 255 else np.uint16 if len(used) < 65535 else np.uint32)
    ends = np.cumsum(lengths)
    bwt, lcp = np.zeros(m, code.dtype), np.zeros(m + 1, np.uint16)
    position, rounds = np.arange(m), int(lengths.max(initial=0))
    for j in range(rounds):
        active = np.flatnonzero(lengths > j)
        at = position[active]
        bwt[at] = code[ends[active] - 1 - j]
        order = np.argsort(bwt, kind="stable")[m - len(active) :]
        fresh = np.zeros(len(bwt), bool)
        fresh[at] = True
        owner = np.zeros(len(bwt), np.int64)
        owner[at] = active
        new = np.flatnonzero(fresh[order])
        # common prefixes on both sides of each new suffix
        right = np.unique(np.concatenate([new, new + 1]))
        right = right[(right > 0) & (right < len(order))]
        a, z = order[right - 1], order[right]
        alike = bwt[a] == bwt[z]
        value = np.zeros(len(right), np.uint16)
        if alike.any():
            bounds = np.stack([a[alike] + 1, z[alike] + 1], 1).ravel()
            value[alike] = np.minimum.reduceat(lcp, bounds)[::2] + 1
        total = len(bwt) + len(new)
        old = np.ones(total, bool)
        old[m + new] = False
        grown_bwt, grown_lcp = np.zeros(total, bwt.dtype), np.zeros(total + 1, np.uint16)
        grown_bwt[old] = bwt
        grown_lcp[:-1][old] = lcp[:-1]
        grown_lcp[m + right] = value
        position[owner[order[new]]] = m + new
        bwt, lcp = grown_bwt, grown_lcp
    return bwt, lcp[:-1]


def repeated_places(strings: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each string whether the ``length`` bytes from each place also start elsewhere in the collection."""
    bwt, lcp = transform(strings)
    m, lengths = len(strings), np.array([len(s) for s in strings])
    long = lcp >= length
    repeated = long.copy()
    repeated[:-1] |= long[1:]
    behind = np.empty(len(bwt), np.int64)
    behind[np.argsort(bwt, kind="stable")[m:]] = np.arange(m, len(bwt))
    flags = np.zeros((m, int(lengths.max(initial=0))), bool)
    at = np.arange(m)
    for j in range(flags.shape[1]):
        active = np.flatnonzero(lengths > j)
        at[active] = behind[at[active]]
        flags[active, lengths[active] - 1 - j] = repeated[at[active]]
    return [flags[i, : max(0, n - length + 1)] for i, n in enumerate(lengths)]


def _cut(length: int):
    core = length - BLOCK + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "wanted")), strict=True):
                data = text.encode()
                for p in parts:
                    anchor = p["first"] + p["lead"]
                    # distances of the places from the anchor, block by block
                    for b in range((p["lead"] - p["more"]) // BLOCK, p["lead"] // BLOCK + 1):
                        a = anchor - min(p["lead"], b * BLOCK + BLOCK - 1)
                        z = anchor - max(p["lead"] - p["more"], b * BLOCK)
                        middle = anchor - b * BLOCK
                        key = xxhash.xxh3_128_digest(b"%d %d " % (p["anchor"], b) + data[middle : middle + core])
                        out.append((key, doc, a, data[a:middle], data[middle + core : z + length]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                names=["key", "doc", "first", "left", "right"])
    return run


def _runs(flags: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(first + int(a), first + int(z) - 1 + length) for a, z in zip(edge[::2], edge[1::2], strict=True)]


def _build(length: int):
    def spans(rows: list[tuple]) -> pa.RecordBatch:
        cores = {key: 256 + i for i, key in enumerate(dict.fromkeys(r[0] for r in rows))}
        strings = [np.concatenate([np.frombuffer(left, np.uint8), [cores[key]], np.frombuffer(right, np.uint8)]) for key, _, _, left, right in rows]
        out = [(r[1], *run) for r, flags in zip(rows, repeated_places(strings, BLOCK), strict=True) for run in _runs(flags, r[2], length)]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by core; a collection ends between two cores
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "first", "left", "right")), strict=True):
                if size >= COLLECTION and row[0] != rows[-1][0]:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3]) + len(row[4]) + 1
        if rows:
            yield spans(rows)
    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, doc, first, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "first", "left", "right")), strict=True):
            for i in range(len(left) + len(right) + 2 - BLOCK):
                out.append((xxhash.xxh3_128_digest(key + left[i:] + b"|" + right[: i + BLOCK - 1 - len(left)]), doc, first + i))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["place", "doc", "start"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, start, end``: byte spans that strings of ``length`` bytes cover which also start elsewhere; spans may overlap.

    ``doc`` is the digest of id and text. Stretches of equal content are aggregated before anything is gathered, so a passage in a third of
    all documents is one row per stretch. Strings of one core go to one task as a collection up to ``MOST``
    of them; beyond that their places are counted one by one over all tasks, with the same result.
    """
    rows = spread(docs.select(digest(F.col("doc_id").cast("long"), "text").alias("doc"), "text"))
    found = store(rows.mapInArrow(_anchor(length), "anchor long, stretch long, doc long, first long, more int, lead int"), "stretches")
    kinds = found.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "more", "lead")).alias("at"))
    live = store(kinds.withColumn("kinds", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1 or kinds > 1"), "live")
    copies = found.join(live.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"]).select(
        "doc", F.col("first").alias("start"), (F.col("first") + F.col("more") + length).alias("end"))
    lists = live.where("kinds > 1").select("at.doc", F.struct("anchor", "at.first", "at.more", "at.lead").alias("w")).groupBy("doc").agg(
        F.collect_list("w").alias("wanted"))
    texts = rows.join(lists, "doc")
    blocks = store(texts.mapInArrow(_cut(length), "key binary, doc long, first long, left binary, right binary"), "blocks")
    shared = store(blocks.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "blocks")
    few = shared.where(F.col("n") <= MOST).repartition("key").sortWithinPartitions("key", "doc", "first")
    spans = few.drop("n").mapInArrow(_build(length), "doc long, start long, `end` long").unionByName(copies)
    many = shared.where(F.col("n") > MOST)
    if not many.isEmpty():
        places = many.mapInArrow(_places, "place binary, doc long, start long")
        again = places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
        spans = spans.unionByName(places.join(again, "place").select("doc", "start", (F.col("start") + length).alias("end")))
    return spans


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            own = batch.slice(piece.first, len(piece))
            ids, out = own.column("doc_id"), []
            for i, spans in enumerate(own.column("spans").to_pylist()):
                data = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                left, at = [], 0
                for a, z in merged:
                    left.append(data[at:a].tobytes())
                    at = z
                left.append(data[at:].tobytes())
                out.append((merged, b"".join(left), len(data)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([[{"start": a, "end": z} for a, z in m] for m, _, _ in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([left for _, left, _ in out], pa.binary()), pa.array([n for _, _, n in out], pa.int64())],
                names=["doc_id", "removed", "kept", "n_bytes"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, removed, kept, n_bytes``, one row per row of ``docs``: maximal removed byte spans and the bytes left.

    Takes ``doc_id, text``; other columns are ignored. A null text counts as empty; texts shorter than ``length`` stay whole. Repeated
    rows are copies of each other, so all their strings of ``length`` go. Cuts may fall inside a character.
    """
    spans = repeated_spans(docs, length).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest(F.col("doc_id").cast("long"), "text").alias("doc"))
    schema = "doc_id long, removed array<struct<start:long,`end`:long>>, kept binary, n_bytes long"
    return rows.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(_remove, schema)

