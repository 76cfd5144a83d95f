"""Quality rules with risk-controlled thresholds.

Base statistics of every text feed rules, scores of which a high value speaks against a text. How high is too high is learned per
stratum from labelled holdouts: of the texts labelled good all rules together may reject the share ``risk`` at most. The rules'
cutoffs form one sequence of nested steps, each of which lowers one cutoff by one bin: first the bins that hold most bad texts
for each unlabelled one. Texts labelled good have no part in this order, so the sequence is fixed before they test it. A step
is admitted when the exact binomial test excludes a larger share of good texts over all rules; the first failure ends
the sequence, which needs no correction for the number of steps or rules. Strata share the error level (Bonferroni). Of the
admitted steps the one with the best balance of bad and good texts rejected is taken, none if none helps. A stratum needs
``ln(error / strata) / ln(1 - risk)`` good texts to admit any: 217 for four strata at 0.05 and 0.02.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.llm.common import spread
from threadsieve.llm.words import mix, pieces, powers, shingles, words
from threadsieve.session import store

RULES = ("symbols", "repeated_lines", "repeated_words", "capitals", "long_words", "marks")
BINS = 200
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MARK = np.isin(np.arange(256), list(b"!?"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_FIRST = (np.arange(256) & 0xC0) != 0x80
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def _lines(piece, w) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, per text: how many, and how many equal to an earlier one (by a hash of their bytes)."""
    data, n = piece.data, len(piece.data)
    cuts = np.flatnonzero(data == 10)
    starts = np.union1d(piece.offsets[:-1], cuts + 1)
    starts = starts[starts < n]
    ends = np.minimum(np.append(starts[1:], n), np.append(cuts, n)[np.searchsorted(cuts, starts)])
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    h, text = h[filled], (np.searchsorted(piece.offsets, starts, "right") - 1)[filled]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    return np.bincount(text, minlength=len(piece)), np.bincount(text[again], minlength=len(piece))


def _repeats(piece, w, size: int = 3) -> np.ndarray:
    """Words that lie in a run of ``size`` words found twice or more in their text."""
    h, at = shingles(w, size)
    text = w.text[at]
    order = np.lexsort((h, text))
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    hit = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(w.starts), bool)
    for j in range(size):
        covered[hit + j] = True
    return np.bincount(w.text[covered], minlength=len(piece))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            w, o, b = words(piece, lower=False), piece.offsets, piece.data
            n = np.diff(w.bounds)
            inside = np.zeros(len(b) + 1, np.int8)
            inside[w.starts] += 1
            np.add.at(inside, w.ends, -1)
            chars = _per_text((np.cumsum(inside[:-1]) > 0) & _FIRST[b], o)
            symbols, marks = _per_text(_SYMBOL[b], o), _per_text(_MARK[b], o)
            lines, dup_lines = _lines(piece, w)
            repeat = _repeats(piece, w)
            letters = _per_text(_LETTER[b], o)
            one = np.maximum(n, 1)
            scores = np.stack([symbols / one, dup_lines / np.maximum(lines, 1), repeat / one, _per_text(_UPPER[b], o) / np.maximum(letters, 1),
                               chars / one / 40, marks / one], 1)
            bins = np.minimum(scores * BINS, BINS - 1).astype(np.int32)
            own = batch.slice(piece.first, len(piece))
            offsets = np.arange(0, bins.size + 1, len(RULES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("stratum"), *[pa.array(x.astype(np.int64)) for x in (n, chars, symbols, dup_lines, repeat)],
                 pa.ListArray.from_arrays(offsets, pa.array(bins.ravel()))],
                names=["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bins"])


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Base statistics and the rules' bins of every whole text; a null text has no words."""
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{stratum}`").cast("string").alias("stratum"), "text"))
    rows = rows.mapInArrow(_measure, f"doc_id long, stratum string, {_BASE}, bins array<int>")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exactly, by summing from k downwards until terms vanish."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log)
    while k > 0 and term > total * 1e-17:
        term *= k * (1 - p) / ((n - k + 1) * p)
        total += term
        k -= 1
    return min(1.0, total)


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float, price: float) -> int:
    """Highest bin that stays: texts in higher bins are rejected. ``good`` and ``bad`` count labelled texts per bin."""
    n, best, cutoff = int(good.sum()), 0.0, len(good) - 1
    for k in range(len(good) - 2, -1, -1):
        lost, caught = int(good[k + 1 :].sum()), int(bad[k + 1 :].sum())
        if not n or binomial_at_most(lost, n, risk) > level:
            break
        if caught - price * lost > best:
            best, cutoff = caught - price * lost, k
    return cutoff


def sequence(bad: np.ndarray, free: np.ndarray) -> list[int]:
    """Order in which bins are given up, as ``rule * BINS + bin``, from counts of bad and of unlabelled texts per rule and bin.

    Within a rule from the highest bin down; bins are pooled until bad texts for each unlabelled one decrease, and all rules' bins are sorted
    by that ratio. Bins are left out from where no more bad texts follow; the lowest always stays.
    """
    out = []
    for rule in range(len(bad)):
        pools: list[tuple[float, float, list[int]]] = []
        for k in range(bad.shape[1] - 1, 0, -1):
            # one text more, spread over all bins, where none is known
            caught, price, bins = float(bad[rule, k]), free[rule, k] + 1 / bad.shape[1], [k]
            while pools and caught * pools[-1][1] >= pools[-1][0] * price:
                last = pools.pop()
                caught, price, bins = caught + last[0], price + last[1], last[2] + bins
            pools.append((caught, price, bins))
        out += [(-caught / price, rule, -k) for caught, price, bins in pools if caught for k in bins]
    return [rule * bad.shape[1] - k for _, rule, k in sorted(out)]


def _orders(groups: pd.DataFrame) -> pd.DataFrame:
    table = np.zeros((2, len(RULES), BINS), np.int64)
    table[0, groups["rule"], groups["bin"]], table[1, groups["rule"], groups["bin"]] = groups["bad"], groups["free"]
    order = sequence(*table)
    steps = np.full(len(RULES) * BINS, len(order), np.int32)
    steps[order] = np.arange(len(order))
    return pd.DataFrame({"of": [groups["stratum"].iloc[0]], "order": [order], "steps": [steps.tolist()]})


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float, error: float, price: float) -> DataFrame:
    """``stratum, cutoffs`` (one per rule) from the texts that pass the base rules.

    Bad and unlabelled texts are counted per rule and bin, labelled ones then per step of their stratum's sequence.
    """
    known = labels.select(F.col("doc_id").alias("_l"), "quality").where("quality is not null")
    texts = measured.where("not base_failed").select("doc_id", "stratum", "bins")
    marked = store(texts.join(known, F.col("doc_id") == F.col("_l")).select("stratum", "quality", "bins"), "marked")
    # null ids have no label and would meet in one task
    free = texts.where("doc_id is not null").join(known, F.col("doc_id") == F.col("_l"), "left_anti").union(texts.where("doc_id is null"))
    both = marked.where("quality = 0").select("stratum", "bins", F.lit(True).alias("is_bad")).union(
        free.select("stratum", "bins", F.lit(False)))
    counts = both.select("stratum", "is_bad", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").agg(
        F.count_if("is_bad").alias("bad"), F.count_if(~F.col("is_bad")).alias("free"))
    orders = store(counts.groupBy("stratum").applyInPandas(_orders, "of string, order array<int>, steps array<int>").where(
        "size(order) > 0"), "orders")
    level = error / max(1, orders.count())

    step = F.array_min(F.transform("bins", lambda b, rule: F.get("steps", rule * BINS + b)))
    same = F.col("stratum").eqNullSafe(F.col("of"))
    tested = marked.join(orders.select("of", "steps"), same).select("stratum", "quality", step.alias("step")).groupBy("stratum", "step").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    tested = tested.groupBy("stratum").agg(F.collect_list(F.struct("step", "good", "bad")).alias("tested"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for order, own in zip(rows["order"], rows["tested"], strict=True):
                # steps from the last one on, behind the texts that no step rejects
                table = np.zeros((2, len(order) + 1), np.int64)
                for r in own:
                    table[:, len(order) - r["step"]] = r["good"], r["bad"]
                limit = np.full(len(RULES), BINS - 1)
                for at in order[: len(order) - choose_cutoff(*table, risk, level, price)]:
                    limit[at // BINS] = at % BINS - 1
                out.append(limit.tolist())
            yield pd.DataFrame({"stratum": rows["stratum"], "cutoffs": out})

    return tested.join(orders, same).select("stratum", "order", "tested").mapInPandas(choose, "stratum string, cutoffs array<int>")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05, price: float = 5.0) -> DataFrame:
    """``doc_id``, base statistics, ``base_failed`` and ``kept``, one row per document.

    ``risk``: share of good texts that may be falsely rejected per stratum, but for a probability of ``error`` overall. ``price``: bad texts that one good
    text is worth when admitted cutoffs are compared. Takes ``doc_id, text``, the stratum column and labels ``doc_id, quality``; other columns are ignored.
    A null or empty text has no words and fails the base rules. Strata without labels, a null one too, keep what passes these. Repeated rows are judged alike.
    Bins are counted with map-side sums, so a stratum with most of the rows is no larger to the driver or any task.
    """
    measured = store(measures(docs, stratum), "measures")
    limits = cutoffs(measured, labels, risk, error, price).withColumnRenamed("stratum", "of")
    rows = measured.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = F.exists(F.zip_with("bins", "cutoffs", lambda b, c: b > c), lambda x: x)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(over, F.lit(False))).alias("kept"))
