"""Substring deduplication by line hashing: repeated lines stay only where they come first.

A line is a unit if it has ``min_words`` words. Units are equal when their words are, upper and lower case A-Z alike; their
128-bit digests are grouped over all documents. The earliest occurrence, by document id, text digest and line number,
stays; all others go, with their place in the original text on record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.llm.common import digest, map_batches, same, spread
from threadsieve.llm.words import mix, pieces, powers, words
from threadsieve.session import store


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w, n = words(piece), len(piece.data)
                cuts = np.flatnonzero(piece.data == 10)
                starts = np.union1d(piece.offsets[:-1], cuts + 1)
                starts = starts[starts < n]
                ends = np.minimum(np.append(starts[1:], n), np.append(cuts, n)[np.searchsorted(cuts, starts)])
                text = np.searchsorted(piece.offsets, starts, "right") - 1
                number = np.arange(len(starts)) - np.searchsorted(text, np.arange(len(piece)))[text]
                a, z = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
                power, inverse = powers(len(w.hashes) + 1)
                keys = []
                for h in (w.hashes, mix(~w.hashes)):
                    sums = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(h * power[:-1], out=sums[1:])
                    keys.append(mix((sums[z] - sums[a]) * inverse[a] + (z - a).astype(np.uint64)).view(np.int64))
                chars = np.zeros(n + 1, np.int64)
                np.cumsum((piece.data & 0xC0) != 0x80, out=chars[1:])
                base = chars[piece.offsets[text]]
                unit = z - a >= min_words
                own = batch.slice(piece.first, len(piece))
                rows = pa.array(text[unit])
                yield pa.RecordBatch.from_arrays([
                    own.column("doc_id").take(rows), own.column("_text").take(rows), pa.array(number[unit].astype(np.int64)),
                    pa.array((chars[starts] - base)[unit]), pa.array((chars[ends] - base)[unit]),
                    pa.array(keys[0][unit]), pa.array(keys[1][unit]),
                ], names=["doc_id", "_text", "line", "start", "end", "k1", "k2"])
    return run


def repeated_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``doc_id, _text, line, start, end, first_doc, first_line``: each line that repeats an earlier one and goes.

    ``_text`` is the digest of the whole text, ``start`` and ``end`` are character offsets in it, without the line break. Groups are
    counted with map-side sums and only repeated digests are joined back, so a line that a third of all documents share is
    one row to the join's other side. Repeated rows count once: they lose the same lines, and keep the same.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    units = store(map_batches(
        rows.select("doc_id", digest("text").alias("_text"), "text"), _units(min_words),
        "doc_id long, _text long, line long, start long, `end` long, k1 long, k2 long"), "units")
    # null ids come last
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("_text").alias("text"), F.col("line").alias("line"))
    firsts = units.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    both = units.join(firsts, ["k1", "k2"])
    again = ~(same("first.doc", "doc_id") & (F.col("first.text") == F.col("_text")) & (F.col("first.line") == F.col("line")))
    return both.where(again).select(
        "doc_id", "_text", "line", "start", "end", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))


def without_repeats(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``doc_id, text, removed``: the text left, and ``line, start, end`` of each removed line, one row per row of ``docs``.

    A line goes with its line break. Null texts stay null and empty ones empty; texts without repeats stay as they are.
    """
    gone = repeated_lines(docs, min_words).groupBy("doc_id", "_text").agg(
        F.sort_array(F.collect_set(F.struct("line", "start", "end"))).alias("removed")).select(
        F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "removed")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest("text").alias("_text"))
    rows = rows.join(gone, same("doc_id", "_d") & (F.col("_text") == F.col("_t")), "left")
    numbers = F.col("removed.line")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(numbers, i.cast("long")))
    return rows.select(
        "doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.coalesce("removed", F.array().cast("array<struct<line:bigint,start:bigint,end:bigint>>")).alias("removed"))
