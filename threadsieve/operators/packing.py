"""Fixed-size token chunks for language-model corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.functions.keys import digest, digest_level
from threadsieve.functions.text import mask_words
from threadsieve.operators.ranking import positions


def batches(df: DataFrame, size: int, row_id: str, name: str = "batch") -> DataFrame:
    """Assign rows, in digest order, to batches of exactly ``size`` (the last may
    be smaller). Adds the batch and the ``place`` in it."""
    keyed = df.withColumn("_digest", digest(F.col(row_id))).withColumn("_l1", digest_level(F.col("_digest")))
    keyed = keyed.withColumn("_all", F.lit(0))
    numbered = positions(keyed, ["_all"], "_l1", [F.col("_digest"), F.col(row_id)])
    return (
        numbered.withColumn(name, F.floor((F.col("position") - 1) / size))
        .withColumn("place", (F.col("position") - 1) % size)
        .drop("_digest", "_l1", "_all", "position")
    )


def pack(df: DataFrame, tokens: str | list[str], batch: str, place: str, chunk_size: int) -> DataFrame:
    """Concatenate the token lists of a batch and cut them into full chunks; the
    remainder of each batch is dropped.

    ``tokens`` names one list, or several of equal length (ids, attention mask,
    word ids), which are cut alike. A list travels as one slice per chunk it
    touches, not as single tokens; a null or empty one takes no room. One
    list comes back as ``tokens``, several under their own names.
    """
    names = [tokens] if isinstance(tokens, str) else list(tokens)
    out = ["tokens"] if isinstance(tokens, str) else names
    w = Window.partitionBy(batch).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_len").over(Window.partitionBy(batch))
    sized = df.where(F.size(names[0]) > 0).withColumn("_len", F.size(names[0]).cast("long"))
    placed = sized.withColumns({"_from": F.coalesce(F.sum("_len").over(w), F.lit(0)), "_total": total})
    whole = F.floor(F.col("_total") / chunk_size)
    last = F.least(F.floor((F.col("_from") + F.col("_len") - 1) / chunk_size), whole - 1)
    first = F.floor(F.col("_from") / chunk_size)
    pieces = placed.where(first <= last).select(
        batch, "_from", "_len", *names, F.explode(F.sequence(first, last)).alias("chunk")
    )
    start = F.greatest(F.col("chunk") * chunk_size - F.col("_from"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * chunk_size - F.col("_from"), F.col("_len"))
    parts = [F.slice(c, (start + 1).cast("int"), (end - start).cast("int")).alias(f"p{i}") for i, c in enumerate(names)]
    return (
        pieces.groupBy(batch, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_from", *parts))).alias("_parts"))
        .select(batch, "chunk", *[F.flatten(F.col(f"_parts.p{i}")).alias(c) for i, c in enumerate(out)])
    )


def word_numbers(word_ids: Column) -> Column:
    """Words of a chunk numbered from 0: neighbouring pieces of one word id are one word, and a null id is none.

    The last word of a list and the first one of the next are one word where they have the same id, and a word that
    continues over the border of a chunk is a word of each.
    """
    def step(state: Column, w: Column) -> Column:
        new = w.isNotNull() & ~w.eqNullSafe(state["last"])
        n = state["n"] + F.when(new, 1).otherwise(0)
        return F.struct(
            F.coalesce(w, state["last"]).alias("last"), n.alias("n"),
            F.concat(state["out"], F.array(F.when(w.isNotNull(), n))).alias("out"))

    empty = F.array().cast("array<int>")
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(-1).alias("n"), empty.alias("out"))
    return F.aggregate(F.transform(word_ids, lambda w: w.cast("int")), zero, step, lambda s: s["out"])


def mask_chunks(
    chunks: DataFrame, tokens: str, word_ids: str, key: list[str], probability: float = 0.15, seed: int = 101,
    mask: str = "[MASK]", special: list[str] | None = None,
) -> DataFrame:
    """Whole-word masking of packed chunks: ``tokens`` masked, with their ``labels``; the word ids are used up.

    The draw of a word depends on the chunk's ``key`` and the word's number in it.
    """
    # the numbers are bound by a lambda, so that they are made once per chunk
    masked = F.get(F.transform(F.array(word_numbers(F.col(word_ids))), lambda ids: mask_words(
        F.col(tokens), ids, F.concat_ws("-", *key), probability, seed, mask, special)), F.lit(0))
    return chunks.withColumn("_m", masked).withColumn(tokens, F.col("_m.tokens")).withColumn(
        "labels", F.col("_m.labels")).drop("_m", word_ids)
