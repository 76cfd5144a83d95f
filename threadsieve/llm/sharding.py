"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``CELLS`` cells. Every shard owns the arcs that end at its virtual nodes. A shard takes the
keys of its own arcs until it is full; keys that find it full continue clockwise to the next virtual
node whose shard has room. How many keys of which cell go where follows from the counts per cell alone: these, at most
``CELLS`` numbers whatever the size of the input, are all that reaches the driver. The keys then find their shard from
their rank in their cell.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.llm.common import digest, expand, one_row_each, row_digest, same
from threadsieve.session import store

CELLS = 1 << 16


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """``(cell, shard)`` of all virtual nodes, clockwise."""
    return sorted((xxhash.xxh3_64_intdigest(f"{s}/{v}".encode()) % CELLS, s) for s in range(shards) for v in range(virtual))


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may take: without slack all of them are filled, so counts differ by one at most."""
    if slack:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def flows(counts: dict[int, int], shards: int, virtual: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """``(cell, first, last, shard, slot)``: ranks first..last of a cell go to a shard, from this slot on."""
    nodes = ring(shards, virtual)
    at = [c for c, _ in nodes]
    room = capacities(sum(counts.values()), shards, slack)
    slot, placed, out = [0] * shards, dict.fromkeys(counts, 0), []
    waiting = [(cell, bisect.bisect_left(at, cell) % len(nodes)) for cell in sorted(counts)]
    while waiting:
        later = []
        for cell, node in waiting:
            shard, first = nodes[node][1], placed[cell]
            n = min(room[shard], counts[cell] - first)
            if n:
                out.append((cell, first, first + n - 1, shard, slot[shard]))
                room[shard] -= n
                slot[shard] += n
                placed[cell] += n
            if placed[cell] < counts[cell]:
                later.append((cell, node))
        # the next virtual node, clockwise, of a shard that has room
        onward, best = [0] * len(nodes), None
        for node in range(2 * len(nodes) - 1, -1, -1):
            onward[node % len(nodes)] = best
            if room[nodes[node % len(nodes)][1]]:
                best = node % len(nodes)
        waiting = [(cell, onward[node]) for cell, node in later]
    return out


def assign(rows: DataFrame, shards: int, virtual: int = 128, slack: float = 0.0) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows of ``doc_id, _digest`` and further narrow columns.

    Identical rows are first counted as one class and written out again at the end, so that a row that
    repeats a billion times is no task of its own.
    """
    point = F.xxhash64("doc_id", "_digest")
    classes = store(rows.groupBy(*rows.columns).agg(F.count("*").alias("_count")).withColumn("_point", point).withColumn(
        "_cell", F.shiftrightunsigned("_point", 48).cast("int")), "classes")
    counts = {r[0]: r[1] for r in classes.groupBy("_cell").agg(F.sum("_count")).collect()}
    found = rows.sparkSession.createDataFrame(
        flows(counts, shards, virtual, slack), "_cell int, first long, last long, shard int, slot long")
    # at most one row for each cell, and one more for each shard that fills up
    lists = F.broadcast(found.groupBy("_cell").agg(F.collect_list(F.struct("first", "last", "shard", "slot")).alias("_parts")))
    before = Window.partitionBy("_cell").orderBy("_point", "doc_id", "_digest", *[c for c in rows.columns if c not in ("doc_id", "_digest")])
    ranked = classes.withColumn("_before", F.sum("_count").over(before) - F.col("_count"))
    placed = expand(ranked, "_count", "_copy").withColumn("_rank", F.col("_before") + F.col("_copy")).join(lists, "_cell")
    part = F.filter("_parts", lambda p: (p["first"] <= F.col("_rank")) & (F.col("_rank") <= p["last"]))[0]
    return placed.withColumn("_part", part).select(
        *rows.columns, F.col("_part.shard").alias("shard"), (F.col("_part.slot") + F.col("_rank") - F.col("_part.first")).alias("slot"))


def shard_sizes(docs: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``, one row per document.

    A row's key on the ring is its id with a digest of its text, so rows that share an id (null too) are spread. Takes
    ``doc_id`` and ``text``; other columns are ignored. ``size`` is the UTF-8 bytes of the text (null: none) plus 16; the
    checksum of a null text is that of an empty one. Without ``slack`` the shards' counts differ by one at most;
    slots run from 0 without gaps. Repeated rows take slots of their own. An empty table has no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), digest("text").alias("_digest"))
    return assign(rows, shards, slack=slack).drop("_digest")


def sharded(docs: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """The whole rows of ``docs`` with ``shard`` and ``slot``; columns of these names are replaced."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(docs).alias("_digest"))
    places = assign(keys, shards, slack=slack).withColumnRenamed("_digest", "_key")
    rows = one_row_each(docs).join(places, same("_id", "doc_id") & same("_digest", "_key"))
    old = [c for c in docs.columns if c.lower() in ("shard", "slot")]
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in old], "shard", "slot")
