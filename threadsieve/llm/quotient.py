"""Counting quotient filters over packed n-grams, as arrays and as bytes.

An n-gram of word ids is packed into ``2 * half`` bits, kept as two halves, and permuted by a Feistel network, which can be undone. The
first bits of the permuted number are its shard, the next ones its quotient, all others its remainder, so nothing is lost and n-grams
come back from the filter exactly. A filter holds one bit per quotient (is there a run), one bit per entry (does its run
end here), the remainders in order and the counts as varints. Entries are sorted by permuted number, so filters
of one shard are merged like sorted runs.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

ROUNDS = 4
HEADER = "<BBHQQQ"
U = np.uint64


def half_bits(words: int, width: int) -> int:
    """Bits of each half of a packed n-gram; at most 64."""
    half = -(-words * width // 2)
    if half > 64:
        raise ValueError(f"{words} ids of {width} bits do not fit 128 bits")
    return half


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def _shift(x: np.ndarray, left: int) -> np.ndarray:
    """Shift by any number of bits, to the right if negative; what leaves the word is lost."""
    if left >= 64 or left <= -64:
        return np.zeros_like(x)
    return x << U(left) if left >= 0 else x >> U(-left)


def pack(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of ids, first word first, as high and low halves."""
    half = half_bits(len(ids), width)
    high, low = np.zeros(len(ids[0]), U), np.zeros(len(ids[0]), U)
    for place, column in enumerate(reversed(ids)):
        column = column.astype(U)
        low |= _shift(column, place * width) & _mask(half)
        high |= _shift(column, place * width - half)
    return high & _mask(half), low


def unpack(high: np.ndarray, low: np.ndarray, words: int, width: int) -> list[np.ndarray]:
    half = half_bits(words, width)
    out = []
    for place in reversed(range(words)):
        at = place * width
        out.append((_shift(low, -at) | _shift(high, half - at)) & _mask(width))
    return out


def _mix(x: np.ndarray, turn: int, half: int) -> np.ndarray:
    x = (x + U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return (x ^ (x >> U(32))) & _mask(half)


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for turn in range(1, ROUNDS + 1):
        high, low = low, high ^ _mix(low, turn, half)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for turn in range(ROUNDS, 0, -1):
        high, low = low ^ _mix(high, turn, half), high
    return high, low


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts. The sort is a merge sort: runs that are sorted are merged."""
    if not len(high):
        return high, low, counts
    order = np.argsort((high << U(half)) | low, kind="stable") if half <= 32 else np.lexsort((low, high))
    high, low, counts = high[order], low[order], counts[order]
    first = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
    starts = np.flatnonzero(first)
    return high[starts], low[starts], np.add.reduceat(counts, starts)


def _varints(values: np.ndarray) -> bytes:
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= U(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        here = size > k
        more = (size[here] > k + 1).astype(np.uint8) << 7
        out[ends[here] - size[here] + k] = ((values[here] >> U(7 * k)) & U(127)).astype(np.uint8) | more
    return out.tobytes()


def _read_varints(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, U)
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(U) << (7 * place).astype(U), starts)


def _columns(values: np.ndarray, bits: int) -> bytes:
    """The low bytes of each number, as many as ``bits`` need."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)]).tobytes()


def _read_columns(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    size = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = data[:n * size].reshape(n, size)
    return out.view("<u8").reshape(n).astype(U)


@dataclass
class Filter:
    """Entries of one shard (its number has ``shard_bits`` bits, the first of the high half), sorted by permuted number."""

    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray
    half: int
    shard_bits: int = 0

    def to_bytes(self) -> bytes:
        n, half = len(self.high), self.half
        bits = min(max(n, 1).bit_length(), half - self.shard_bits)
        shard = int(self.high[0]) >> (half - self.shard_bits) if n else 0
        rest = half - self.shard_bits - bits
        quotient = (_shift(self.high, -rest) & _mask(bits)).astype(np.int64)
        runs = np.zeros(1 << bits, bool)
        runs[quotient] = True
        run_ends = np.append(quotient[1:] != quotient[:-1], True)[:n]
        high, low = self.high & _mask(rest), self.low
        if rest + half <= 64:
            remainders = _columns((high << U(half)) | low if half < 64 else low, rest + half)
        else:
            remainders = _columns(high, rest) + _columns(low, half)
        return struct.pack(HEADER, half, self.shard_bits, bits, len(remainders), n, shard) + np.packbits(runs).tobytes() + \
            np.packbits(run_ends).tobytes() + remainders + _varints(self.counts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        half, shard_bits, bits, size, n, shard = struct.unpack_from(HEADER, data)
        rest = half - shard_bits - bits
        raw = np.frombuffer(data, np.uint8, offset=struct.calcsize(HEADER))
        at = -(-(1 << bits) // 8)
        runs = np.flatnonzero(np.unpackbits(raw[:at], count=1 << bits))
        run_ends = np.unpackbits(raw[at:at + -(-n // 8)], count=n)
        at += -(-n // 8)
        # The quotient of an entry: the run that it belongs to, as many runs have ended before it.
        quotient = runs[np.cumsum(run_ends) - run_ends].astype(U) if n else np.zeros(0, U)
        if rest + half <= 64:
            both = _read_columns(raw[at:at + size], n, rest + half)
            high, low = _shift(both, -half), both & _mask(half)
        else:
            cut = n * -(-rest // 8)
            high, low = _read_columns(raw[at:at + cut], n, rest), _read_columns(raw[at + cut:at + size], n, half)
        high |= _shift(quotient, rest) | _shift(np.full(n, shard, U), half - shard_bits)
        return cls(high, low, _read_varints(raw[at + size:]), half, shard_bits)

    def holds(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which of these permuted numbers are entries."""
        found = np.zeros(len(high), bool)
        if not len(self.high):
            return found
        if self.half <= 32:
            keys, wanted = (self.high << U(self.half)) | self.low, (high << U(self.half)) | low
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return keys[at] == wanted
        at, end = np.searchsorted(self.high, high), np.searchsorted(self.high, high, side="right")
        while (open_ := at < end).any():
            found[open_] |= self.low[at[open_]] == low[open_]
            at = at + 1
        return found


def shards(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, shard_bits: int):
    """``(shard, bytes)`` of each shard's filter, from sorted distinct entries."""
    number = _shift(high, shard_bits - half) if shard_bits else np.zeros(len(high), U)
    cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(high) else []
    for start, end in zip(cuts, [*cuts[1:], len(high)]):
        part = slice(start, end)
        yield int(number[start]), Filter(high[part], low[part], counts[part], half, shard_bits).to_bytes()


def merged(parts: list[bytes], least: int = 1) -> Filter:
    """Filters of one shard as one, without the entries counted fewer than ``least`` times."""
    filters = [Filter.from_bytes(p) for p in parts]
    half, shard_bits = filters[0].half, filters[0].shard_bits
    high, low, counts = counted(*(np.concatenate([getattr(f, c) for f in filters]) for c in ("high", "low", "counts")), half)
    enough = counts >= U(least)
    return Filter(high[enough], low[enough], counts[enough], half, shard_bits)
