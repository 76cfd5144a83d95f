"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One binary classifier per bit, logistic over hashed byte n-grams, predicts that bit for a
text; the language whose codeword loses least is chosen, where each bit's loss counts by how well its
classifier separates. A small gap between the best two flags the answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.llm.common import map_batches, spread, whole
from threadsieve.llm.samples import per_class
from threadsieve.llm.words import LOWER, Piece, pieces

GRAMS = 1 << 17
# Labelled rows per language that the fit reads at most.
PER_LANGUAGE = 500
ROUNDS, RATE, SCALE = 40, 0.3, 30.0
# Longest random code; few languages have all splits into two sides as bits.
MAX_BITS = 24
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def grams(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 2- and 3-grams of folded texts and the index of their text."""
    b = _FOLD[piece.data].astype(np.int64)
    text = np.repeat(np.arange(len(piece)), np.diff(piece.offsets))
    out = []
    if len(b) > 1:
        two = b[:-1] << 8 | b[1:]
        out.append((two, text[:-1], (text[:-1] == text[1:]) & (two != 0x2020)))
    if len(b) > 2:
        three = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * 0x9E3779B1 >> 12 & 0xFFFF) + (1 << 16)
        out.append((three, text[:-2], (text[:-2] == text[2:]) & (b[1:-1] != 32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([g[k] for g, _, k in out]), np.concatenate([t[k] for _, t, k in out])


def codewords(n: int) -> np.ndarray:
    """Rows of +-1: all splits for up to four languages, else the random code with the largest least distance of 50 drawn."""
    if n <= 4:
        bits = [[1 if i >> k & 1 else -1 for k in range(n)] for i in range(1, max(2, 1 << (n - 1)))]
        return np.array(bits).T.reshape(n, -1)
    rng, best = np.random.default_rng(5), None
    for _ in range(50):
        code = rng.choice([-1, 1], (n, MAX_BITS))
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            g, t = grams(piece)
            key, n = np.unique(t * GRAMS + g, return_counts=True)
            bounds = np.searchsorted(key, np.arange(len(piece) + 1) * GRAMS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.slice(piece.first, len(piece)).column("lang"), pa.ListArray.from_arrays(bounds, pa.array((key % GRAMS).astype(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int32)))], names=["lang", "g", "n"])


class Model:
    """Weights per n-gram and bit, codewords and bit weights."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, code: np.ndarray, trust: np.ndarray):
        self.langs, self.weights, self.bias, self.code, self.trust = langs, weights, bias, code, trust

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probability of each language: softmax of its weighted logistic loss over the bits."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from rows ``doc_id, text, lang``; rows without language or letters teach nothing. None without any."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    rows = map_batches(per_class(rows, "lang", per_language).select("text", "lang"), _count, "lang string, g array<int>, n array<int>")
    table = rows.toArrow().combine_chunks()
    sample = [(lang.as_py(), g.values.to_numpy(), n.values.to_numpy().astype(np.float32))
              for lang, g, n in zip(table["lang"], table["g"], table["n"], strict=True) if len(g)]
    if not sample:
        return None
    sample.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    langs = sorted({lang for lang, _, _ in sample})
    code = codewords(len(langs))
    y = np.array([langs.index(lang) for lang, _, _ in sample])
    share = 1 / np.bincount(y)[y] / len(langs)
    g = np.concatenate([g for _, g, _ in sample])
    v = np.concatenate([SCALE * n / n.sum() for _, _, n in sample])
    doc = np.repeat(np.arange(len(sample)), [len(g) for _, g, _ in sample])
    weights, bias, trust = np.zeros((GRAMS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.zeros(code.shape[1])
    for bit in range(code.shape[1]):
        target, w, b, m, s = code[y, bit], np.zeros(GRAMS), 0.0, np.zeros(GRAMS + 1), np.zeros(GRAMS + 1)
        for step in range(1, ROUNDS + 1):
            margin = np.bincount(doc, v * w[g], len(sample)) + b
            slope = -target * share / (1 + np.exp(target * margin))
            d = np.append(np.bincount(g, v * slope[doc], GRAMS), slope.sum())
            m, s = 0.9 * m + 0.1 * d, 0.99 * s + 0.01 * d * d
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        weights[:, bit], bias[bit] = w, b
        wrong = (share * (target * margin <= 0)).sum()
        trust[bit] = np.log((1 - wrong + 0.01) / (wrong + 0.01))
    return Model(langs, weights, bias, code, np.maximum(trust, 0.01) / max(trust.max(), 0.01))


def _predict(model: Model | None, gap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                own = batch.slice(piece.first, len(piece))
                texts = own.column("text").to_pylist()
                known = np.array([bool(t) and next(filter(str.isalpha, t), None) is not None for t in texts])
                if model is None:
                    known[:] = False
                    p = np.zeros((len(texts), 1))
                else:
                    g, t = grams(piece)
                    n = np.maximum(np.bincount(t, minlength=len(texts)), 1)
                    margins = np.stack([
                        SCALE * np.bincount(t, model.weights[g, k], len(texts)) / n + model.bias[k] for k in range(model.code.shape[1])], 1)
                    p = model.decode(margins)
                best = p.argmax(1)
                score = np.where(known, p.max(1), 0.0)
                second = np.partition(p, -2, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
                names = [model.langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own.column("row"), pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score - second < gap))],
                    names=["row", "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, model: Model | None, gap: float = 0.1) -> DataFrame:
    """``row, lang_pred, score, ambiguous`` for every row of ``docs``, ``row`` holding all its columns.

    Only ``text`` is read. A null text, or one without a letter, is ``und`` with score 0 and ambiguous, as is every text without a
    model. ``ambiguous``: the two best languages lie less than ``gap`` apart. Repeated rows get equal answers.
    """
    rows = spread(docs).select(whole(docs).alias("row"), "text")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"
    return map_batches(rows, _predict(model, gap), schema)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that a model may learn from: checksum of the id modulo 4 is not 2."""
    return docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
