"""Near-duplicate documents by MinHash: one permutation, optimal densification, bands, star edges.

Every text becomes the set of hashes of its distinct word shingles. One hash per shingle serves all positions of
the signature: the hash range is cut into ``BINS`` bins and a bin holds the least hash that falls into it. An
empty bin borrows from a filled one that a fixed random sequence, the same for all texts, picks for it (optimal
densification), so texts of few shingles keep unbiased signatures. ``ROWS`` bins make a band; texts that agree
in a whole band share its bucket.

Texts of equal sets are one node, so exact copies never meet each other in a bucket. A bucket of few members gives all its
pairs. A larger one gives the edges of a star: each member with a centre, a node that sits in the fullest buckets of all that the members know. Centres are compared
with members on their full sets, which also yields how each member differs from its centre: the shingles added and
those missing. Two members that share none of these differences are no more similar than the less similar of them is
to the centre. So a link that the star does not show, between a member that failed and any other, needs
differences in common, and how many follows from the sizes. Differences that no such pair can share, most often those of one
member alone, are left out by counting. The first of the others (a prefix, as in set joins), the rarest of the star first,
make the buckets of the next round, in which only members of different components stay. Stars thus
bound the pairs where copies are many, and no candidate pair of a bucket is lost.
At the threshold a pair misses all of its buckets with probability ``(1 - t ** ROWS) ** BANDS``, 3e-7 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.llm.common import digest, map_batches, spread, whole
from threadsieve.llm.components import components
from threadsieve.llm.words import mix, pieces, shingle_sets
from threadsieve.session import store

BANDS, ROWS, WORDS = 32, 6, 5
BINS = BANDS * ROWS
# A bucket of up to this many members is compared pair by pair.
FEW = 32
# Rounds in which the buckets of a group share a centre.
SHARED_CENTRES = 2
# Differences of a star that are counted together; those of a larger one are dealt by their hash.
PART = 1 << 18
MEMBER = ["a", "b", "linked", "root_b", "k", "common"]
_EDGES = (np.arange(BINS + 1, dtype=object) * (1 << 64) // BINS)
_LOW = np.array([int(x) for x in _EDGES[:-1]], np.uint64)


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Densified signature of each set of sorted hashes; rows of empty sets are zero."""
    n = len(bounds) - 1
    values, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    for i in range(n):
        own = h[bounds[i] : bounds[i + 1]]
        if len(own):
            first = np.searchsorted(own, _LOW)
            has = np.diff(first, append=len(own)) > 0
            filled[i] = has
            values[i, has] = own[first[has]]
    row, bin_ = np.nonzero(~filled & filled.any(1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (mix(bin_.astype(np.uint64) * np.uint64(0x100000001) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        found = filled[row, donor]
        values[row[found], bin_[found]] = values[row[found], donor[found]]
        row, bin_ = row[~found], bin_[~found]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    key = np.zeros((len(values), BANDS), np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, j::ROWS])
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            h, bounds = shingle_sets(piece, WORDS)
            sizes = np.diff(bounds)
            nodes = np.array([xxhash.xxh3_64_intdigest(h[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
            some = np.flatnonzero(sizes)
            keys = bands(signatures(h, bounds)[some]).view(np.int64)
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(np.where(sizes > 0, BANDS, 0), out=offsets[1:])
            own = batch.slice(piece.first, len(piece))
            yield pa.RecordBatch.from_arrays([
                own.column("doc_id"), own.column("_text"), pa.array(sizes.astype(np.int64)),
                pa.array(nodes.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
            ], names=["doc_id", "_text", "n_shingles", "_node", "_bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, _text (digest), n_shingles, _node (digest of the set), _bands``, one row per document."""
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return map_batches(
        rows.select("doc_id", digest("text").alias("_text"), "text"), _sketch, "doc_id long, _text long, n_shingles long, _node long, _bands array<long>")


_MISSING = np.uint64(0xA5A5A5A5A5A5A5A5)


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, center_set = None, None
        for batch in batches:
            ids = batch.column("a").to_numpy()
            texts, star = batch.column("text_a"), batch.column("star").to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column("text_b")):
                h, bounds = shingle_sets(piece, WORDS)
                linked, changes = [], []
                for i in range(len(piece)):
                    at = piece.first + i
                    if ids[at] != centre:
                        centre = ids[at]
                        center_set = shingle_sets(next(pieces(texts.slice(at, 1))), WORDS)[0]
                    own = h[bounds[i] : bounds[i + 1]]
                    place = np.minimum(np.searchsorted(center_set, own), len(center_set) - 1)
                    common = center_set[place] == own
                    missing = np.ones(len(center_set), bool)
                    missing[place[common]] = False
                    n = int(common.sum())
                    linked.append(100 * n >= percent * (len(own) + len(center_set) - n))
                    changes.append(np.concatenate([own[~common], center_set[missing] ^ _MISSING]) if star[at] else own[:0])
                offsets = np.zeros(len(piece) + 1, np.int32)
                np.cumsum([len(c) for c in changes], out=offsets[1:])
                pair = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([
                    *(pair.column(c) for c in ("a", "b", "root_a", "root_b", "star")), pa.array(linked), pa.array(np.diff(bounds).astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(changes).view(np.int64))),
                ], names=["a", "b", "root_a", "root_b", "star", "linked", "n", "changes"])
    return run


def compare(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with ``linked, n, changes``: on their full shingle sets, the size of b's set and its differences from a's.

    A text travels to its pair as a text, which takes less room than its hashes. Rows of one centre are sorted together, so
    that its set is made once per task.
    """
    sides = texts.select(F.col("_node").alias("b"), F.col("text").alias("text_b"))
    centres = texts.select(F.col("_node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(sides, "b").join(centres, "a").select("a", "b", "root_a", "root_b", "star", "text_a", "text_b")
    return map_batches(
        both, _compare(percent), "a long, b long, root_a long, root_b long, star boolean, linked boolean, n long, changes array<long>")


def _pairs(live: DataFrame, shared: bool) -> DataFrame:
    """``a, b, root_a, root_b, star``: what is to be compared where a link may still join two components.

    A bucket of few members gives all its pairs and is done; a larger one each member with its fullest. In the first
    rounds (``shared``), when all of a group meet in many buckets, one centre serves them: each node knows the fullest node of all its buckets, and
    a bucket takes the fullest that a member knows, itself a member or not.
    """
    groups = live.groupBy("bucket").agg(
        F.max(F.struct("pull", "_node", "root")).alias("top"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.max("failed").alias("failed"), F.count("*").alias("members")).where("failed and lo <> hi")
    large = live.join(groups.where(F.col("members") > FEW).select("bucket", "top"), "bucket")
    if shared:
        known = large.groupBy("_node").agg(F.max("top").alias("top"))
        large = large.drop("top").join(known, "_node")
    chosen = large.groupBy("bucket").agg(F.max("top").alias("centre"))
    stars = large.select("bucket", "_node", "root").join(chosen, "bucket").select(
        F.col("centre._node").alias("a"), F.col("_node").alias("b"), F.col("centre.root").alias("root_a"), F.col("root").alias("root_b"),
        F.lit(True).alias("star")).where("a <> b")
    small = live.join(groups.where(F.col("members") <= FEW).select("bucket"), "bucket").groupBy("bucket").agg(
        F.sort_array(F.collect_set(F.struct("_node", "root", "failed"))).alias("m"))
    each = small.select(F.posexplode("m").alias("at", "x"), "m").select(
        "x", F.explode(F.slice("m", F.col("at") + 2, F.greatest(F.size("m") - F.col("at") - 1, F.lit(0)))).alias("y"))
    both = each.where("(x.failed or y.failed) and x.root <> y.root and x._node <> y._node").select(
        F.col("x._node").alias("a"), F.col("y._node").alias("b"), F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b"),
        F.lit(False).alias("star"))
    return stars.unionByName(both).groupBy("a", "b", "root_a", "root_b").agg(F.max("star").alias("star"))


def _count_holders(part: pa.Table) -> pa.Table:
    """The differences of one part that a failed member and one of another component have, each with its number of holders."""
    held, root, failed = part["size"].to_numpy(), part["root_b"].to_numpy(), ~part["linked"].to_numpy()
    f, row = part["changes"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(part.num_rows), held)
    order = np.argsort(f, kind="stable")
    f, row = f[order], row[order]
    first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
    holders = np.diff(np.append(first, len(f)))
    wanted = np.maximum.reduceat(failed[row], first) & (np.minimum.reduceat(root[row], first) != np.maximum.reduceat(root[row], first))
    at = np.flatnonzero(np.repeat(wanted, holders))
    at = at[np.argsort(row[at], kind="stable")]
    offsets = np.zeros(part.num_rows + 1, np.int32)
    np.cumsum(np.bincount(row[at], minlength=part.num_rows), out=offsets[1:])
    useful = pa.StructArray.from_arrays([pa.array(np.repeat(holders, holders)[at]), pa.array(f[at])], names=["holders", "f"])
    return part.select(MEMBER).append_column("useful", pa.ListArray.from_arrays(offsets, useful))


def _useful(rows: DataFrame) -> DataFrame:
    """``a, b, linked, root_b, k, common, useful``: the differences of each member that may be shared by a pair to be found, in
    an order of the star: fewest holders first.

    Members are sent as arrays, so a star gives a row per member and part, not one per difference. A part holds about
    ``PART`` differences; one that most members have lies in one part with all its holders, about 200 bytes each.
    """
    part = F.explode(F.array_distinct(F.transform("changes", lambda f: F.pmod(f, F.col("parts"))))).alias("part")
    dealt = rows.select(*MEMBER, "parts", "changes", part)
    dealt = dealt.withColumn("changes", F.filter("changes", lambda f: F.pmod(f, F.col("parts")) == F.col("part")))
    dealt = dealt.select(*MEMBER, "part", "changes", F.size("changes").alias("size"))
    counted = dealt.groupBy("a", "part").applyInArrow(
        _count_holders, "a long, b long, linked boolean, root_b long, k long, common long, useful array<struct<holders:bigint,f:bigint>>")
    return counted.groupBy(*MEMBER).agg(F.sort_array(F.flatten(F.collect_list("useful"))).alias("useful"))


def _next_buckets(checked: DataFrame, percent: int) -> DataFrame:
    """``bucket, _node, root, pull, failed``: members of a star that may be linked with each other though not over its centre.

    A pair of sizes n and m and similarity t differs in at most ``slack = (n + m) * (1 - t) / (1 + t)`` shingles, where m is at
    most ``n / t`` and at most the largest of the star. With k and l differences from the centre it shares at least
    ``(k + l - slack) / 2`` of them; l is at least the least of the star, or of its failed members when the pair's own side is
    linked. Of the differences only those count that a failed member and a member of another component have: a pair has all
    that it shares among them.
    """
    rows = checked.withColumn("k", F.size("changes").cast("long"))
    stars = rows.groupBy("a").agg(
        F.min("k").alias("least"), F.min(F.when(~F.col("linked"), F.col("k"))).alias("free"), F.max("n").alias("most"),
        F.min("root_b").alias("lo"), F.max("root_b").alias("hi"), F.ceil(F.sum("k") / PART).alias("parts"),
    ).where("free is not null and lo <> hi").select("a", "least", "free", "most", "parts")
    rows = rows.join(stars, "a")
    largest = F.least(F.col("most"), F.floor(F.col("n") * 100 / percent))
    slack = F.floor((F.col("n") + largest) * (100 - percent) / (100 + percent))
    other = F.greatest(F.when(F.col("linked"), F.col("free")).otherwise(F.col("least")), F.col("k") - slack)
    common = F.greatest(F.lit(1), F.ceil((F.col("k") + other - slack) / 2))
    rows = rows.withColumn("common", common).where("common <= k")
    # only differences that may be shared by a pair still to be found are counted for the prefix, the rarest of a star first
    each = _useful(rows).withColumn("prefix", F.size("useful") - F.col("common") + 1).where("prefix > 0").select(
        "a", "b", "linked", "root_b", "k", F.explode(F.slice("useful", F.lit(1), F.col("prefix").cast("int"))).alias("f"))
    # both sides of the join below read the prefixes; stored, they are exploded once
    each = store(each.withColumn("key", F.xxhash64("a", "f.f")).drop("a", "f"), "prefixes")
    shared = each.groupBy("key").agg(F.count("*").alias("among")).where("among > 1").select("key")
    first = each.join(shared, "key")
    return first.select(
        F.col("key").alias("bucket"), F.col("b").alias("_node"), F.col("root_b").alias("root"), (-F.col("k")).alias("pull"),
        (~F.col("linked")).alias("failed"))


def _links(nodes: DataFrame, texts_of, percent: int) -> DataFrame:
    """``node, root`` of all nodes that have a confirmed link. Nodes carry their root through a round; only new links change it."""
    rows = nodes.select("_node", F.explode("_bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    live = store(rows.join(shared, "bucket"), "buckets")
    texts = store(texts_of(live.select("_node").distinct()), "texts")
    fullness = live.groupBy("_node").agg(F.sum("n").alias("pull"))
    live = live.join(fullness, "_node").select("bucket", "_node", F.col("_node").alias("root"), "pull", F.lit(True).alias("failed"))
    edges, rounds = None, 0
    while True:
        live = store(live, "buckets")
        if edges is not None and live.isEmpty():
            return roots
        checked = store(compare(_pairs(live, rounds < SHARED_CENTRES), texts, percent), "checked")
        found = checked.where("linked and root_a <> root_b").select("a", "b")
        if edges is None or not found.isEmpty():
            roots = components(found if edges is None else edges.unionByName(found))
            edges = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b")
            known = roots.select(F.col("node").alias("b"), "root")
            checked = checked.join(known, "b", "left").withColumn("root_b", F.coalesce("root", "b")).drop("root")
        live = _next_buckets(checked.where("star"), percent)
        rounds += 1


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Class of each document among those linked by a shingle similarity of ``percent`` hundredths or more.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns one row per row of ``docs``: ``doc_id, n_shingles,
    component_id, kept``, ``_text``, a digest of the text, and ``_root``, the class itself (null without shingles): classes that share
    an id, or have null ids only, also share their ``component_id``. That is the smallest id reachable over
    links, the own one included. A null or empty text and one without words have no shingles and no links. Repeated rows
    and texts of equal sets are linked. Rows that share an id stay apart unless their texts are linked. Null ids
    are never the smallest; ``kept`` is ``doc_id <=> component_id``.
    """
    sketch = store(sketches(docs), "sketches")
    some = sketch.where("n_shingles > 0")
    nodes = some.groupBy("_node").agg(
        F.min("doc_id").alias("least"), F.min("_text").alias("_text"), F.first("n_shingles").alias("n_shingles"),
        F.first("_bands").alias("_bands"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        keys = nodes.select("_node", "_text").join(wanted, "_node")
        own = docs.select(digest("text").alias("_text"), "text")
        return own.join(keys, "_text").dropDuplicates(["_node"]).select("_node", "text")

    roots = _links(nodes, texts_of, percent)
    least = nodes.select("_node", "least").join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    least = least.withColumn("root", F.coalesce("root", "_node"))
    best = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.select("_node", "root").join(best, "root").select("_node", "component_id", F.col("root").alias("_root"))
    known = sketch.select("doc_id", "_text", "n_shingles", "_node").join(named, "_node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return known.select(
        "doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "_text", "_root")


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents with one of each near-duplicate class: that of the smallest id, one of its repeated rows.

    Classes are told apart by their root, not by that id: unlinked documents of one id, or of null ids, each stay.
    All columns stay, whatever their names. Documents without words are all kept.
    """
    classes = near_duplicates(docs, percent).where("kept and n_shingles > 0")
    # the id of all kept rows of a class is its component_id, so the least text picks one of them
    some = classes.groupBy("_root", "doc_id").agg(F.min("_text").alias("_text")).select("doc_id", "_text")
    # null ids as a mark of their own: the join then deals the wide rows by the very columns of the last step, which needs no other shuffle
    own = F.col("doc_id").cast("long")
    key = [F.coalesce(own, F.lit(0).cast("long")).alias("_id"), own.isNull().alias("_none")]
    rows = docs.select(whole(docs).alias("row"), *key, digest("text").alias("_text"), "text")
    full = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    names = ["_id", "_none", "_text"]
    picked = rows.where(full).join(some.select(*key, "_text"), names).dropDuplicates(names)
    return picked.select("row.*").union(rows.where(~full).select("row.*"))
