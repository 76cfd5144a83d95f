"""Phrase collocations by counting quotient filters.

Words that are frequent in their language get dense ids. Every task packs the n-grams of these ids, permutes them,
counts them in its own quotient filters and sends the filters, one for each shard of the permuted numbers; a shard's filters are
merged as sorted runs, and entries below the least count are dropped. A phrase can be frequent only if its words and both of its
ends are, so an n-gram is counted only where the shorter ones before it were frequent. The merged filters give
the phrases and their counts back exactly; scores are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.llm import quotient
from threadsieve.llm.common import spread
from threadsieve.session import store

# n-grams that a task gathers before it counts them, and entries that it keeps before it sends its filters.
GATHER, KEEP = 2_000_000, 1_000_000
WORDS_AT_ONCE = 500_000
# Occurrences of words for each shard of the filters.
SHARD_WORDS = 4_000_000
# Bytes of word digests, or of one order's merged filters, that may be sent to every task; beyond, digests are
# joined and the next order is counted without looking the shorter phrases up.
SENT_BYTES = 32 << 20
BUCKET_BITS = 16
BREAK = "\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in order, with ``BREAK`` between pieces and at the end."""
    text = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    text = F.regexp_replace(F.concat(text, F.lit(BREAK)), r"[.,;:!?\x0A-\x0D]+", f" {BREAK} ")
    return F.split(F.btrim(text, F.lit(" \t")), r"[\x20\x09]+")


def vocabulary(docs: DataFrame, least: int, seed: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """Frequent words ``id, digest, lang, word, f``, occurrences per language ``lang, n``, and the seed of the digests.

    Ids run from 1 in the order of digests: a bucket's offset is the number of words before it. A seed under which a frequent word shares
    its digest with any other word is passed over.
    """
    found = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).where(~F.col("word").isin(BREAK, ""))
    counted = store(found.groupBy("lang", "word").agg(F.count("*").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    while True:
        keyed = counted.withColumn("digest", F.xxhash64("lang", "word", F.lit(seed)))
        alike = keyed.groupBy("digest").agg(F.count("*").alias("words"), F.max("f").alias("f"))
        if not alike.where(((F.col("words") > 1) | (F.col("digest") == 0)) & (F.col("f") >= least)).head(1):
            break
        seed += 1
    bucket = F.shiftright("digest", 64 - BUCKET_BITS)
    frequent = keyed.where(F.col("f") >= least).withColumn("bucket", bucket)
    frequent = store(frequent.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("digest"))), "frequent")
    sizes = dict(frequent.groupBy("bucket").count().collect())
    before, offsets = 0, []
    for b in sorted(sizes):
        offsets.append((b, before))
        before += sizes[b]
    # at most one row for each of the 65,536 buckets
    starts = F.broadcast(docs.sparkSession.createDataFrame(offsets, "bucket long, before long"))
    numbered = frequent.join(starts, "bucket").select((F.col("before") + F.col("place")).alias("id"), "digest", "lang", "word", "f")
    return store(numbered, "vocabulary"), totals, seed


def sliced(lists: pa.ListArray, n: int) -> Iterator[pa.ListArray]:
    """Neighbouring lists, as many as have about ``n`` values together; a longer one is on its own."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
    at = 0
    while at < len(lists):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + n, side="right")))
        yield lists.slice(at, end - at)
        at = end


def _to_ids(sent):
    """Digests of each row as ids, rare words and breaks as 0; only what stands beside another id is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for rows in (part for batch in batches for part in sliced(batch.column(0), WORDS_AT_ONCE)):
            digests = rows.flatten().to_numpy(zero_copy_only=False)
            if not len(digests):
                continue
            at = np.minimum(np.searchsorted(known, digests), max(len(known) - 1, 0))
            ids = np.where(known[at] == digests, at + 1, 0).astype(np.int32) if len(known) else np.zeros(len(digests), np.int32)
            ids = np.concatenate([ids, [0]]).astype(np.int32)
            beside = np.append(ids[1:] > 0, False) | np.append(False, ids[:-1] > 0)
            ids[~beside] = 0
            ids = ids[(ids > 0) | np.append(True, ids[:-1] > 0)]
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int32()))], names=["ids"])

    return run


def id_lists(docs: DataFrame, words: DataFrame, seed: int, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``ids``: arrays of word ids, 0 for rare words and breaks.

    The digests of the frequent words are sent to the tasks if they are few enough; else every word is joined with its id.
    """
    spark = docs.sparkSession
    lang = F.col("lang")
    digests = F.transform(words_of(F.col("text")), lambda w: F.when(w.isin(BREAK, ""), F.lit(0).cast("long")).otherwise(
        F.xxhash64(lang, w, F.lit(seed))))
    n = words.count()
    if 8 * n <= sent_bytes:
        known = words.select("digest").orderBy("digest").toPandas()["digest"].to_numpy(np.int64)
        return docs.select(digests.alias("digests")).mapInArrow(_to_ids(spark.sparkContext.broadcast(known)), "ids array<int>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), digests.alias("digests"))
    rows = rows.select("row", F.posexplode("digests").alias("place", "digest"))
    found = rows.join(words.select("digest", F.col("id").cast("int").alias("id")), "digest", "left")
    return found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("id", F.lit(0)).alias("id")))).alias("ids")).select(
        F.col("ids.id").alias("ids"))


def _windows(ids: np.ndarray, order: int, width: int, shorter: dict[int, quotient.Filter | None]) -> np.ndarray:
    """Where an n-gram of this order starts whose shorter ones, as far as they were looked up, are all frequent."""
    ids = np.append(ids, np.zeros(order, ids.dtype))
    start = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    for n in range(2, order):
        held = shorter.get(n)
        if held is not None:
            high, low = quotient.pack([ids[start + k] for k in range(n)], width)
            start = start[held.holds(*quotient.permute(high, low, held.half))]
        if len(start):
            # the next longer one begins where this one and the one after it do
            start = start[:-1][start[1:] == start[:-1] + 1]
    return start


def _count(order: int, width: int, shard_bits: int, sent):
    half = quotient.half_bits(order, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = {n: f and quotient.merged(f) for n, f in sent.value.items()}
        none = np.zeros(0, np.uint64)
        entries, waiting, gathered = (none, none, none), [], 0

        def settle():
            high, low = (np.concatenate([entries[i], *[w[i] for w in waiting]]) for i in (0, 1))
            ones = np.ones(len(high) - len(entries[2]), np.uint64)
            return quotient.counted(high, low, np.concatenate([entries[2], ones]), half)

        def filters():
            found = list(quotient.shards(*entries, half, shard_bits))
            return pa.RecordBatch.from_arrays([
                pa.array([s for s, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["shard", "part"])

        for batch in batches:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), WORDS_AT_ONCE):
                part = ids[at:at + WORDS_AT_ONCE + order - 1]
                start = _windows(part, order, width, shorter)
                start = start[start < WORDS_AT_ONCE]
                waiting.append(quotient.permute(*quotient.pack([part[start + k] for k in range(order)], width), half))
                gathered += len(start)
                if gathered >= GATHER:
                    entries, waiting, gathered = settle(), [], 0
                    if len(entries[0]) > KEEP:
                        yield filters()
                        entries = (none, none, none)
        entries = settle()
        yield filters()

    return run


def _merge(least: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        one = quotient.merged(group.column("part").to_pylist(), least)
        rows = [one.to_bytes()] if len(one.high) else []
        return pa.table({"shard": pa.array([key[0].as_py()] * len(rows), pa.int64()), "part": pa.array(rows, pa.binary())})

    return run


def _phrases(order: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                one = quotient.Filter.from_bytes(part)
                ids = np.stack(quotient.unpack(*quotient.restore(one.high, one.low, one.half), order, width), axis=1).astype(np.int64)
                flat = pa.array(ids.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, order, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([lists, pa.array(one.counts.astype(np.int64))], names=["ids", "f"])

    return run


def frequent_phrases(ids: DataFrame, width: int, words: int, least: int, longest: int, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``ids, f``: n-grams of 2 to ``longest`` ids that occur ``least`` times or more."""
    spark = ids.sparkSession
    shorter: dict[int, list[bytes] | None] = {}
    out = spark.createDataFrame([], "ids array<long>, f long")
    for order in range(2, longest + 1):
        wanted = max(words // SHARD_WORDS, spark.sparkContext.defaultParallelism)
        shard_bits = min(wanted.bit_length(), quotient.half_bits(order, width))
        parts = ids.mapInArrow(_count(order, width, shard_bits, spark.sparkContext.broadcast(shorter)), "shard long, part binary")
        merged = store(parts.groupBy("shard").applyInArrow(_merge(least), "shard long, part binary"), f"phrases-{order}")
        out = out.unionByName(merged.select("part").mapInArrow(_phrases(order, width), "ids array<long>, f long"))
        size = merged.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()[0]
        if not size:
            break
        shorter = shorter | {order: [r.part for r in merged.select("part").collect()] if size <= sent_bytes else None}
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, covered: int = 100, top: int = 2000,
                 sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    Takes ``lang`` and ``text``; other columns are ignored. A null lang is ``und``, a null text is empty, repeated rows count each, texts
    are read whole whatever their length. ``score`` is floor(1000 * a * n / (l * r)) of the lowest-scoring cut, ties to the first.
    A phrase inside a longer frequent one that has ``covered`` percent of its occurrences is left out; a phrase one word
    longer tells, since counts only fall with every further word. Without rows the result is empty.
    """
    docs = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"))
    words, totals, seed = vocabulary(docs, least)
    size = words.count()
    ids = store(id_lists(docs, words, seed, sent_bytes), "ids")
    occurrences = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    phrases = frequent_phrases(ids, max(size.bit_length(), 1), occurrences, least, longest, sent_bytes)
    single = words.select(F.array("id").alias("ids"), "f")
    counts = store(phrases.unionByName(single), "counts")
    many = counts.where(F.size("ids") > 1)

    longer = counts.where(F.size("ids") > 2).select(
        F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), "f")
    most = longer.groupBy("ids").agg(F.max("f").alias("most"))
    kept = many.join(most, "ids", "left").where(
        F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < covered * F.col("f").cast("decimal(20,0)")))
    kept = kept.select("ids", F.col("f").alias("a"))

    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("tail"))
    cuts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    langs = words.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("first", F.col("ids")[0]).join(langs, "first")
    cuts = cuts.withColumn("score", F.expr(
        "(1000 * cast(a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    scored = cuts.groupBy("ids").agg(F.min(F.struct("score", "k", "lang", "a", "l", "r", "n")).alias("cut")).select("ids", "cut.*")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    scored = scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place")
    spelled = scored.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    named = spelled.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(at, word))), x -> x.word), ' ')").alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
