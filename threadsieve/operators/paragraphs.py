"""Near-duplicate paragraphs by the cosine of their vectors: of similar ones in a text the last stays.

Vectors are sparse rows of a table, one per paragraph: word counts, or whatever the caller supplies. Equal vectors are settled by
grouping. The others get blocks inside their document, bits of the sides of random hyperplanes they lie on; a pair at the
threshold 0.98 shares none of them with probability 3e-11. A document of many vectors gets blocks of more bits, and more of them for the same
probability, so that the pairs of its blocks grow as its vectors do. Paragraphs meet the later ones of their blocks, the nearest first and more
in each round, until a similar one is found or none is left; only vectors that share a block, and whose sides of further
hyperplanes differ no more than similar ones may (missed with probability 6e-15), are multiplied out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from threadsieve.functions import text as tx
from threadsieve.session import hint_if_small, store

# A pair at 0.98 lies on one side of a hyperplane with probability ``_SIDE``, and shares no block of 40 of 12 bits with 3e-11.
_SIDE = 1 - math.acos(0.98) / math.pi
BANDS, BITS = 40, 12
# Bits of a block that a document may choose from, and the bands that miss a pair as rarely as 40 of 12 bits.
LEVELS = {b: math.ceil(BANDS * math.log1p(-(_SIDE**BITS)) / math.log1p(-(_SIDE**b))) for b in range(BITS, 33, 2)}
# Documents of up to this many vectors take the first level.
FIRST_LEVEL = 512
# Further hyperplanes of a vector, and on how many of them a similar pair may lie on different sides.
SKETCH, APART = 256, 56
_SKETCH_FROM, _TRIAL_FROM = 1 << 20, 1 << 21
# Vector entries whose projections a task makes at once, at the first level.
ENTRIES_AT_ONCE = 20_000
# Later members of a block that a paragraph meets in the first round, and how many times more in each next one.
FIRST_ROUND, GROWTH = 16, 4
# Texts of up to this many paragraphs are compared inside their own row.
IN_ROW = 64


def projections(ids: np.ndarray, first: int = 1, count: int = BANDS * BITS) -> np.ndarray:
    """A near-normal number for each id and bit, from a hash: the sum of its eight bytes."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(first, first + count, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return x.view(np.uint8).reshape(*x.shape, 8).sum(axis=2, dtype=np.int32).astype(np.float32) - 1020.0


def sides(ids: np.ndarray, values: np.ndarray, sizes: np.ndarray, first: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors, by their places, and the side of each of ``count`` hyperplanes they lie on; ``sizes`` entries after another."""
    ends, at, most = np.cumsum(sizes), 0, max(1, ENTRIES_AT_ONCE * BANDS * BITS // count)
    while at < len(sizes):
        done = ends[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        here = slice(done, ends[end - 1])
        known, place = np.unique(ids[here], return_inverse=True)
        filled = np.flatnonzero(sizes[at:end])
        if len(filled):
            normals, own = projections(known, first, count), values[here].astype(np.float32)
            if len(filled) * len(known) <= 4 * len(own):
                # vectors over the same ids, as supplied ones are, are one product
                row = np.repeat(np.arange(len(filled)), sizes[at:end][filled])
                table = np.zeros((len(filled), len(known)), np.float32)
                np.add.at(table, (row, place), own)
                yield at + filled, table @ normals > 0
            else:
                starts = (ends - sizes)[at:end][filled] - done
                yield at + filled, np.add.reduceat(normals[place] * own[:, None], starts, axis=0) > 0
        at = end


def block_numbers(ids: np.ndarray, values: np.ndarray, sizes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One number per band for each vector, ``sizes`` entries after another."""
    bands = LEVELS[bits]
    out = np.zeros((len(sizes), bands), np.int64)
    for at, side in sides(ids, values, sizes, 1, bands * bits):
        out[at] = side.reshape(len(at), bands, bits) @ (1 << np.arange(bits)) + (np.arange(bands) << bits)
    return out


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, values = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "values"))
    return ids, values, batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels = batch.column("bits").to_numpy()
        for bits in np.unique(levels):
            own = batch.filter(pa.array(levels == bits))
            ids, values, sizes = _lists(own)
            numbers = block_numbers(ids, values, sizes, int(bits))
            sketch = np.zeros((len(own), SKETCH // 64), np.int64)
            for at, side in sides(ids, values, sizes, _SKETCH_FROM, SKETCH):
                sketch[at] = np.packbits(side, axis=1).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (numbers, sketch)]
            yield pa.RecordBatch.from_arrays([own.column("doc"), own.column("place"), *lists], names=["doc", "place", "blocks", "sketch"])


def _trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most = max(LEVELS)
    for batch in batches:
        ids, values, sizes = _lists(batch)
        out = np.zeros(len(batch), np.int64)
        for at, side in sides(ids, values, sizes, _TRIAL_FROM, most):
            out[at] = side @ (1 << np.arange(most))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out)], names=["doc", "block"])


def block_bits(vectors: DataFrame) -> DataFrame:
    """``doc, bits`` of documents that need more than the first level: the level whose bands have the fewest members and pairs.

    The pairs of every level are counted in one block of each vector, made for this alone. Documents of near copies keep their pairs at
    any level; they meet few of them, since a similar one ends the search.
    """
    large = vectors.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > FIRST_LEVEL)
    large = hint_if_small(store(large, "large").select(F.col("doc").alias("_d"), "n"))
    some = vectors.join(large, F.col("doc") == F.col("_d")).select("doc", "ids", "values")
    tried = some.mapInArrow(_trial, some.select("doc").schema.add("block", LongType()))
    levels = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.col("block").bitwiseAND(F.lit((1 << b) - 1)).alias("block")) for b in LEVELS]))
    full = tried.select("doc", levels.alias("l")).groupBy("doc", "l.bits", "l.block").agg(F.count("*").cast("double").alias("n"))
    bands = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("bits"))
    costs = full.groupBy("doc", "bits").agg(F.sum(F.col("n") * (F.col("n") + 1) / 2).alias("rows"))
    return costs.groupBy("doc").agg(F.min_by("bits", F.struct(bands * F.col("rows"), "bits")).alias("bits"))


def _similar(threshold: float):
    limit = threshold * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("a", "b"):
                lists = batch.column(f"ids_{side}"), batch.column(f"values_{side}")
                sides.append(([x.values.to_numpy(zero_copy_only=False) for x in lists], lists[0].offsets.to_numpy()))
            ((a_ids, a_values), a_at), ((b_ids, b_values), b_at) = sides
            norms = [batch.column(c).to_numpy() for c in ("norm_a", "norm_b")]
            hit = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = slice(a_at[i], a_at[i + 1]), slice(b_at[i], b_at[i + 1])
                other, wanted = b_ids[b], a_ids[a]
                at = np.minimum(np.searchsorted(other, wanted), len(other) - 1)
                both = other[at] == wanted
                dot = float((a_values[a][both] * b_values[b][at[both]]).sum())
                hit[i] = dot > 0 and dot * dot > limit * norms[0][i] * norms[1][i]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("i")], names=["doc", "place"]).filter(pa.array(hit))

    return run


def superseded(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``doc, place`` of the paragraphs that a later one of their document is similar to, each once.

    Takes ``doc`` (any type that can be joined), ``place`` (long, distinct in a document) and a sparse vector: ``ids`` array<long> ascending, ``values``
    array<double>. Vectors of length 0, and null ones, are similar to none. ``threshold`` lies between 0.98 and 1, not included;
    below it blocks would miss more pairs.
    """
    if not 0.98 <= threshold < 1:
        raise ValueError("threshold must be at least 0.98 and below 1")
    norm = F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v)
    rows = vectors.select("doc", F.col("place").cast("long").alias("place"), "ids", "values", norm.alias("norm")).where("norm > 0")
    rows = store(rows.withColumn("same", F.md5(F.concat_ws(" ", F.to_json("ids"), F.to_json("values")))), "paragraphs")
    last = rows.groupBy("doc", "same").agg(F.max("place").alias("last"), F.count("*").alias("n"))
    gone = rows.select("doc", "same", "place").join(last.where("n > 1"), ["doc", "same"]).where("place < last").select("doc", "place")

    found = [gone]
    own = store(rows.join(last.select(F.col("doc").alias("_d"), F.col("same").alias("_s"), "last"),
                          (F.col("doc") == F.col("_d")) & (F.col("same") == F.col("_s")) & (F.col("place") == F.col("last")))
                .select("doc", "place", "ids", "values", "norm"), "paragraphs")
    levels = hint_if_small(store(block_bits(own), "bits").select(F.col("doc").alias("_d"), "bits"))
    leveled = own.join(levels, F.col("doc") == F.col("_d"), "left").select("doc", "place", "ids", "values", F.coalesce("bits", F.lit(BITS)).alias("bits"))
    blocks = leveled.mapInArrow(
        _blocks, own.select("doc", "place").schema.add("blocks", ArrayType(LongType())).add("sketch", ArrayType(LongType())))
    members = blocks.select("doc", "place", F.explode("blocks").alias("block"), "sketch")
    block = Window.partitionBy("doc", "block")
    members = members.withColumn("size", F.count("*").over(block)).where("size > 1")
    members = store(members.withColumn("rank", F.row_number().over(block.orderBy("place"))), "blocks")
    later = members.select("doc", "block", "rank", F.col("place").alias("j"), F.col("sketch").alias("sketch_j"))
    apart = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("sketch_j", F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0))
    waiting, first, width = members.where("rank < size"), 1, FIRST_ROUND
    while not waiting.isEmpty():
        steps = F.sequence(F.lit(first), F.least(F.lit(first + width - 1), F.col("size") - F.col("rank")))
        each = waiting.select("doc", "block", F.col("place").alias("i"), F.explode(steps).alias("step"), "rank", "sketch")
        pairs = each.select("doc", "block", "i", "sketch", (F.col("rank") + F.col("step")).cast("int").alias("rank")).join(
            later, ["doc", "block", "rank"]).where(apart <= APART).select("doc", "i", "j").distinct()
        ends = [own.select("doc", F.col("place").alias(p), F.col("ids").alias(f"ids_{s}"), F.col("values").alias(f"values_{s}"),
                            F.col("norm").alias(f"norm_{s}")) for p, s in (("i", "a"), ("j", "b"))]
        both = pairs.join(ends[0], ["doc", "i"]).join(ends[1], ["doc", "j"])
        similar = store(both.mapInArrow(_similar(threshold), own.select("doc", "place").schema).distinct(), "similar")
        found.append(similar)
        first, width = first + width, width * GROWTH
        waiting = waiting.where(F.col("rank") + first <= F.col("size")).join(similar, ["doc", "place"], "left_anti")
        waiting = store(waiting, "waiting")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def dense(vector: Column) -> tuple[Column, Column]:
    """Ids and values of an array of numbers."""
    values = F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))
    return F.transform(values, lambda _, i: i.cast("long")), values


def drop_similar_vectors(paragraphs: DataFrame, doc: str, place: str, vector: str, threshold: float = 0.98) -> DataFrame:
    """The rows of a paragraph table without those that a later row of their document is similar to, by the caller's ``vector``.

    Rows of a null document or place, or without a vector, stay. Places of a document are distinct.
    """
    ids, values = dense(F.col(vector))
    known = paragraphs.where(F.col(doc).isNotNull() & F.col(place).isNotNull())
    gone = superseded(known.select(F.col(doc).alias("doc"), F.col(place).alias("place"), ids.alias("ids"), values.alias("values")), threshold)
    gone = gone.select(F.col("doc").alias("_doc"), F.col("place").alias("_place"))
    return paragraphs.join(gone, (F.col(doc) == F.col("_doc")) & (F.col(place) == F.col("_place")), "left_anti")


def drop_similar_paragraphs(
    df: DataFrame, text: str = "email", separator: str = "\n\n", threshold: float = 0.98, name: str | None = None, in_row: int = IN_ROW,
) -> DataFrame:
    """Texts without the paragraphs whose word counts nearly equal those of a later one.

    Few paragraphs are compared in their own row. The paragraphs of longer texts become rows of their own, equal texts once, so that a text
    of many paragraphs is spread over tasks.
    """
    parts = F.split(F.col(text), separator)
    long_text = F.coalesce(F.size(parts) > in_row, F.lit(False))
    name = name or text
    short = df.where(~long_text).withColumn(name, tx.dedup_similar_paragraphs(F.col(text), separator, threshold))
    texts = df.where(long_text).select(F.md5(text).alias("doc"), F.col(text).alias("t")).dropDuplicates(["doc"])
    each = texts.select("doc", F.posexplode(F.split("t", separator)).alias("place", "paragraph"))
    counts = tx.run_lengths(F.regexp_extract_all(F.lower("paragraph"), F.lit(rf"[{tx.WORD}]+"), F.lit(0)))
    entries = F.sort_array(F.transform(counts, lambda e: F.struct(F.xxhash64(e["term"]).alias("id"), e["n"].cast("double").alias("v"))))
    vectors = each.select("doc", "place", entries.alias("e")).select("doc", "place", F.col("e.id").alias("ids"), F.col("e.v").alias("values"))
    gone = superseded(vectors, threshold)
    kept = each.withColumn("place", F.col("place").cast("long")).join(gone, ["doc", "place"], "left_anti").groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("place", "paragraph"))).alias("kept"))
    joined = kept.select(F.col("doc").alias("_doc"), F.array_join(F.col("kept.paragraph"), separator).alias("_kept"))
    changed = df.where(long_text).withColumn("_key", F.md5(text)).join(joined, F.col("_key") == F.col("_doc"))
    return short.unionByName(changed.withColumn(name, F.col("_kept")).drop("_key", "_doc", "_kept"))
