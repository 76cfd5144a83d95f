"""Toxicity by subword-bag embeddings, averaged into a linear softmax and trained jointly in numpy.

The bag of a stretch of text holds the hashed character n-grams of its words, so a misspelt word shares most of its
vectors with the word meant. A text is cut into stretches of ``STRETCH`` words; each averages its vectors, and the text has the
probability of its most toxic stretch, so one insult counts alike in short and long texts. Embeddings and softmax learn
together from the labels, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.llm.common import spread
from threadsieve.llm.samples import per_class
from threadsieve.llm.words import LOWER, Piece, mix, pieces, words

BUCKETS, DIM, STRETCH = 1 << 16, 8, 40
SIZES = (3, 4, 5)
# Labelled rows per label that the fit reads at most.
PER_LABEL = 1500
# n-grams whose weights the fit holds at once; the driver keeps two bytes of each n-gram of the sample.
AT_ONCE = 1 << 20
ROUNDS, RATE, DECAY, PRIOR, SCALE = 40, 0.1, 1e-3, 60.0, 40.0
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32


def bags(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram, its stretch, and the text of each stretch (each text has one at least)."""
    folded = Piece(piece.first, _FOLD[piece.data], piece.offsets)
    w, b, n = words(folded), folded.data, len(folded.data)
    within = np.arange(len(w.starts)) - w.bounds[:-1][w.text]
    counts = np.maximum(1, -(-np.diff(w.bounds) // STRETCH))
    first = np.concatenate([[0], np.cumsum(counts)])
    stretch_of_word = first[w.text] + within // STRETCH
    text = np.repeat(np.arange(len(piece)), counts)
    length = w.ends - w.starts
    grams, owners = [], []
    # a word of m bytes between two marks has m + 2 - size + 1 n-grams
    padded_start = np.zeros(len(w.starts) + 1, np.int64)
    np.cumsum(length + 2, out=padded_start[1:])
    owner = np.repeat(np.arange(len(w.starts)), length + 2)
    place = np.arange(padded_start[-1]) - padded_start[owner]
    source = np.clip(w.starts[owner] + place - 1, 0, max(n - 1, 0))
    marked = (place == 0) | (place == length[owner] + 1)
    c = np.where(marked, 1, b[source] if n else 0).astype(np.uint64)
    for size in SIZES:
        m = len(c) - size + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for j in range(size):
            h = h * np.uint64(257) + c[j : j + m]
        keep = owner[:m] == owner[size - 1 :]
        grams.append((mix(h[keep] + np.uint64(size)) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(stretch_of_word[owner[:m][keep]])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), text
    return np.concatenate(grams), np.concatenate(owners), text


class Model:
    """Score of each bucket, the product of its embedding and the softmax weights, and the bias."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def score(self, piece: Piece) -> np.ndarray:
        g, s, text = bags(piece)
        logit = SCALE * np.bincount(s, self.value[g], len(text)) / (np.bincount(s, minlength=len(text)) + PRIOR) + self.bias
        best = np.full(len(piece), -np.inf)
        np.maximum.at(best, text, logit)
        return 1 / (1 + np.exp(-best))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """``doc_id, text, label`` of the documents that a fit reads: at most ``per_label`` ids of each label 0 and 1.

    ``labels`` has ``doc_id`` and ``label``. Ids of the least hash are chosen first, without texts; these ids, ``2 * per_label`` at
    most, are then broadcast to the documents, so no text is shuffled. Null ids and labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi").distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    chosen = known.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_label).drop("_rn")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def fit(labelled: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from rows ``doc_id, text, label`` (0 or 1); without both labels every text scores 0.5 or less."""
    rows = labelled.select("doc_id", "text", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    rows = per_class(rows, "label", per_label).select(F.xxhash64("doc_id", "text").alias("key"), "text", "label")
    sample = rows.mapInArrow(_keyed, "key long, label int, g array<array<smallint>>").toArrow().sort_by(
        [("key", "ascending"), ("label", "ascending")]).combine_chunks()
    y = sample["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -4.0)
    bag = sample["g"].combine_chunks()
    text = np.repeat(np.arange(len(y)), np.diff(bag.offsets.to_numpy()))
    stretches = bag.flatten()
    g = stretches.flatten().to_numpy().view(np.uint16)
    ends = stretches.offsets.to_numpy() - stretches.offsets[0].as_py()
    sizes = np.diff(ends)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], AT_ONCE)), len(sizes)))
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    scale = SCALE / (sizes + PRIOR)
    share = 0.5 / np.bincount(y)[y]
    rng = np.random.default_rng(3)
    state = [rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    first, largest = [np.zeros_like(x) for x in state], [0.0] * 3
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    for step in range(1, ROUNDS + 1):
        embed, out_w, bias = state
        toward = out_w[:, 1] - out_w[:, 0]
        value, total = embed @ toward, np.zeros(len(sizes))
        for a, z in parts:
            s = np.repeat(np.arange(z - a), sizes[a:z])
            total[a:z] = np.bincount(s, value[g[ends[a] : ends[z]]], z - a)
        logit = total * scale + bias[1] - bias[0]
        top = np.maximum.reduceat(logit, starts)
        slope = share * (1 / (1 + np.exp(-top)) - y)
        # in the first half the label speaks for all stretches of a text, then for its highest one
        if step <= ROUNDS // 2:
            per = (share / np.bincount(text))[text] * (1 / (1 + np.exp(-logit)) - y[text])
        else:
            is_top = logit == top[text]
            per = np.where(is_top, slope[text], 0.0) / np.bincount(text, is_top)[text]
        weight, pull = per * scale, np.zeros(BUCKETS)
        for a, z in parts:
            pull += np.bincount(g[ends[a] : ends[z]], np.repeat(weight[a:z], sizes[a:z]), BUCKETS)
        d_toward = pull @ embed
        grads = [pull[:, None] * toward + DECAY * embed, np.stack([-d_toward, d_toward], 1), np.array([-per.sum(), per.sum()])]
        # one step size per table, so that a rare n-gram moves as little as it tells
        for k, d in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * d
            largest[k] = 0.99 * largest[k] + 0.01 * float((d * d).max())
            state[k] = state[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(largest[k] / (1 - 0.99**step)) + 1e-8)
    embed, out_w, bias = state
    return Model((embed @ (out_w[:, 1] - out_w[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            g, s, text = bags(piece)
            order = np.argsort(s, kind="stable")
            inner = np.searchsorted(s[order], np.arange(len(text) + 1)).astype(np.int32)
            outer = np.searchsorted(text, np.arange(len(piece) + 1)).astype(np.int32)
            own = batch.slice(piece.first, len(piece))
            lists = pa.ListArray.from_arrays(inner, pa.array(g[order].astype(np.uint16).view(np.int16)))
            yield pa.RecordBatch.from_arrays(
                [own.column("key"), own.column("label"), pa.ListArray.from_arrays(outer, lists)], names=["key", "label", "g"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``, one row per document; reads the whole text and nothing else.

    A null or empty text has an empty bag: its score is that of the bias. Repeated rows score alike.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(piece.first, len(piece)).column("doc_id"), pa.array(model.score(piece))], names=["doc_id", "score"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")
