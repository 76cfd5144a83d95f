"""Word and shingle hashes of Arrow text columns, computed over whole batches of bytes.

A word is a maximal run of bytes other than ``0x20`` and ``0x09-0x0D``. Hashes are 64 bits wide: polynomial in
the bytes modulo 2^64, then mixed. Texts of a batch are handled together in pieces of about a megabyte, so the
memory needed does not grow with the batch; a longer text is a piece of its own and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse; grown on demand, at most for the longest piece."""
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES * 2)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Piece:
    """Consecutive texts of a batch: ``data`` are their bytes, text i at ``offsets[i]:offsets[i + 1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of a column (null: empty) in pieces of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield Piece(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a piece in order: first byte, byte after the last, index of the text, hash."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]


def words(piece: Piece, lower: bool = True) -> Words:
    b = LOWER[piece.data] if lower else piece.data
    n = len(b)
    inside = ~SPACE[b]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = piece.offsets[:-1][np.diff(piece.offsets) > 0]
    before[filled] = False
    after[filled[filled > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    bounds = np.searchsorted(starts, piece.offsets)
    text = np.repeat(np.arange(len(piece)), np.diff(bounds))
    return Words(starts, ends, text, hashes, bounds)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one text, and the index of its first word."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.text[:n] == w.text[size - 1 :])
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = (h + w.hashes[j : j + n]) * _BASE
    return mix(h[at]), at


def sequence(hashes: np.ndarray) -> int:
    """One hash for a whole short sequence of words; the length counts."""
    h = np.uint64(0x5851F42D4C957F2D + len(hashes))
    with np.errstate(over="ignore"):
        for x in hashes:
            h = (h + x) * _BASE
    return int(mix(np.array([h], np.uint64))[0])


def shingle_sets(piece: Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each text, and the bounds of the texts.

    Letters A-Z count as a-z. A text of fewer words than ``size`` has its whole sequence as its only
    shingle; a text without words has none.
    """
    w = words(piece)
    h, at = shingles(w, size)
    text = w.text[at]
    counts = np.diff(w.bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([sequence(w.hashes[w.bounds[i] : w.bounds[i + 1]]) for i in short], np.uint64)
        order = np.argsort(np.concatenate([text, short]), kind="stable")
        h, text = np.concatenate([h, extra])[order], np.concatenate([text, short])[order]
    bounds = np.searchsorted(text, np.arange(len(piece) + 1))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        h[a:z].sort()
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(piece) + 1))
