"""Fuzzy removal of boilerplate sentences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.functions.text import split_sentences

THRESHOLD = 90.0
# What is left of a sentence: its letters and the blanks between words.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_ "
# Sentences that a task remembers.
SEEN = 500_000


def indel_similarity(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), by a bit-parallel LCS."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def plain_words(text: str) -> str:
    """ASCII letters, digits and underscores in lower case, the rest as spaces."""
    return re.sub(r"\W", " ", text.encode("ascii", "ignore").decode()).lower()


def token_set_similarity(a: str, b: str, floor: float = 0.0) -> float:
    """Similarity of two word sets, 0 to 100.

    The shared words are compared with each side, and the sides with each
    other; a set inside the other scores 100. Below ``floor`` the exact value
    does not matter and 0 may be returned.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    only_x, only_y = " ".join(sorted(x - both)), " ".join(sorted(y - both))
    if both and (not only_x or not only_y):
        return 100.0
    shared = " ".join(sorted(both))
    gap = 1 if both else 0
    left, right = len(shared) + gap + len(only_x), len(shared) + gap + len(only_y)
    best = 0.0
    if both:
        # The shared words are a prefix of either side, so the LCS is known.
        best = max(200.0 * len(shared) / (len(shared) + n) for n in (left, right))
    # Even if the shorter rest were found whole in the longer one.
    bound = 200.0 * min(left, right) / (left + right)
    if bound <= best or bound < floor:
        return best
    inner = indel_similarity(only_x, only_y) * (len(only_x) + len(only_y)) / 200.0
    return max(best, 200.0 * (len(shared) + gap + inner) / (left + right))


@dataclass
class PhraseSets:
    """Word sets of phrases as arrays: postings of words, sizes, lengths and character counts.

    Most pairs of a sentence and a phrase are decided by them: a set inside the other is similar, and neither the lengths nor the
    characters in common of most others allow the threshold. Only the rest is compared character by character.
    """

    words: list[list[str]]
    postings: dict[str, np.ndarray]
    sizes: np.ndarray
    chars: np.ndarray
    bags: np.ndarray

    @classmethod
    def of(cls, phrases: list[str]) -> PhraseSets:
        words = sorted({tuple(sorted(set(plain_words(p).split()))) for p in phrases} - {()})
        postings: dict[str, list[int]] = {}
        for i, some in enumerate(words):
            for w in some:
                postings.setdefault(w, []).append(i)
        return cls([list(w) for w in words], {w: np.array(at) for w, at in postings.items()},
                   np.array([len(w) for w in words], np.int64), np.array([sum(map(len, w)) for w in words], np.int64),
                   np.array([char_counts(w) for w in words], np.int64).reshape(len(words), len(LETTERS)))

    def similar(self, sentence: str, threshold: float) -> bool:
        """Whether any phrase's similarity, rounded, reaches the threshold."""
        mine = sorted(set(plain_words(sentence).split()))
        if not mine or not self.words:
            return False
        n, length = len(mine), sum(map(len, mine))
        common, shared = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        for w in mine:
            at = self.postings.get(w)
            if at is not None:
                common[at] += 1
                shared[at] += len(w)
        if ((common > 0) & ((common == n) | (common == self.sizes))).any():
            return True
        # lengths of words joined by blanks: those in common, and each side as common words and then its own
        both = shared + np.maximum(common - 1, 0)
        left, right = (total + count - 1 for total, count in ((length, n), (self.chars, self.sizes)))
        best = np.where(common > 0, 200.0 * both / (both + np.minimum(left, right)), 0.0)
        if (np.rint(best) >= threshold).any():
            return True
        floor = threshold - 0.5
        open_ = np.flatnonzero(200.0 * np.minimum(left, right) / (left + right) >= floor)
        if len(open_):
            alike = np.minimum(self.bags[open_], char_counts(mine)).sum(axis=1)
            open_ = open_[200.0 * alike / (left + right[open_]) >= floor]
        text = " ".join(mine)
        return any(round(token_set_similarity(text, " ".join(self.words[i]), floor)) >= threshold for i in open_)


def char_counts(words: Iterable[str]) -> list[int]:
    """Counts of each letter in the words joined by blanks."""
    text = " ".join(words)
    return [text.count(c) for c in LETTERS]


def remove_similar_phrases(
    df: DataFrame, phrases: list[str], text: str = "email", threshold: float = THRESHOLD, name: str | None = None
) -> DataFrame:
    """Drop the sentences whose word set is similar to one of the phrases.

    Case and punctuation do not count; the similarity is rounded to a whole
    number before it is compared, so ``threshold - 0.5`` is enough. Sentences
    that a task has met are not compared again.
    """
    sets = PhraseSets.of(phrases)

    @F.pandas_udf("array<string>")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, bool] = {}

        def stays(s: str) -> bool:
            if s not in seen:
                seen[s] = not sets.similar(s, threshold)
            return seen[s]

        for column in batches:
            if len(seen) > SEEN:
                seen.clear()
            yield column.map(lambda xs: None if xs is None else [s for s in xs if stays(s)])

    sentences = F.transform(split_sentences(F.col(text)), lambda s: F.regexp_replace(s, "\n", " "))
    return df.withColumn(name or text, F.array_join(keep(sentences), " "))
