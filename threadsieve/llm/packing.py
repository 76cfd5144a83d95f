"""Bounded-space online packing of tokenised documents into fixed windows.

Every task keeps a few open windows. A document's remainder, after its full windows, goes to the open window that it
fills best; when it fits none and no window may be opened, the fullest one is filled up with its head and emitted, and its tail
opens the next. What the tasks leave open is packed again, some dozens of tasks at a time, until one
group is left; its last windows are poured together and the rest is cut at powers of two. No window is padded.
"""

from __future__ import annotations

import os
import sys
import types
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.llm.common import spread
from threadsieve.session import store

# Tasks whose open windows are packed together in one group: at most this many times ``windows`` windows.
TASKS_AT_ONCE = 64
# Characters that are tokenised in one call, and the bytes of ids that leave a task in one batch.
CHARS_AT_ONCE = 1 << 21
BYTES_AT_ONCE = 8 << 20
# Words whose tokens a worker remembers, and those that it tokenises in one call; letters and digits after which a sentence mark is a token of its own.
KNOWN_WORDS, WORDS_AT_ONCE, PLAIN = 250_000, 4096, "a-z0-9À-ÖØ-öø-ſ"
# A sequence's number: level of the merge, task or group, place there.
LEVEL_BITS, TASK_BITS = 58, 28

PIECE = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
OPEN = PIECE + ", task long, open_window int"


@dataclass(eq=False)
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens),
                Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens))


@dataclass(eq=False)
class Open:
    free: int
    pieces: list[Piece] = field(default_factory=list)

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.free -= len(piece.ids)


class Packer:
    """The open windows of one task. ``add`` and ``close`` return the sequences that are finished, as lists of pieces."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows, self.open = size, windows, []

    def _emit(self, window: Open) -> list[Piece]:
        self.open.remove(window)
        return window.pieces

    def add(self, piece: Piece) -> list[list[Piece]]:
        done = []
        while len(piece.ids) >= self.size:
            head, piece = piece.cut(self.size)
            done.append([head])
        if not len(piece.ids):
            return done
        fits = [w for w in self.open if w.free >= len(piece.ids)]
        if fits:
            best = min(fits, key=lambda w: w.free)
            best.put(piece)
            if not best.free:
                done.append(self._emit(best))
            return done
        if len(self.open) == self.windows:
            fullest = min(self.open, key=lambda w: w.free)
            head, piece = piece.cut(fullest.free)
            fullest.put(head)
            done.append(self._emit(fullest))
        self.open.append(Open(self.size))
        self.open[-1].put(piece)
        return done

    def close(self) -> list[list[Piece]]:
        """Pour the emptiest window into the fullest until one is left; cut that at powers of two."""
        done = []
        while len(self.open) > 1:
            giver = max(self.open, key=lambda w: w.free)
            self.open.remove(giver)
            for piece in giver.pieces:
                while len(piece.ids):
                    if not self.open:
                        self.open.append(Open(self.size))
                    taker = min(self.open, key=lambda w: w.free)
                    head, piece = piece.cut(min(taker.free, len(piece.ids)))
                    taker.put(head)
                    if not taker.free:
                        done.append(self._emit(taker))
        rest = self.open.pop().pieces if self.open else []
        left = sum(len(p.ids) for p in rest)
        while left:
            room = part = 1 << (left.bit_length() - 1)
            left -= part
            sequence = []
            while room:
                head, tail = rest[0].cut(min(room, len(rest[0].ids)))
                sequence.append(head)
                room -= len(head.ids)
                rest = [tail, *rest[1:]] if len(tail.ids) else rest[1:]
            done.append(sequence)
        return done


class Rows:
    """Pieces on their way out of a task."""

    def __init__(self, level: int, task: int):
        self.base, self.task, self.number, self.rows, self.bytes = (level << LEVEL_BITS) | (task << TASK_BITS), task, 0, [], 0

    def _piece(self, piece: Piece, sequence: int | None, offset: int, window: int | None) -> None:
        ids = piece.ids.astype("<u4").tobytes()
        self.bytes += len(ids)
        self.rows.append((piece.doc_id, piece.start, ids, piece.doc_tokens, sequence, offset, self.task, window))

    def _all(self, pieces: list[Piece], sequence: int | None, window: int | None) -> None:
        offset = 0
        for piece in pieces:
            self._piece(piece, sequence, offset, window)
            offset += len(piece.ids)

    def sequences(self, done: list[list[Piece]]) -> None:
        for pieces in done:
            self._all(pieces, self.base | self.number, None)
            self.number += 1

    def leftovers(self, windows: list[Open]) -> None:
        for number, window in enumerate(windows):
            self._all(window.pieces, None, number)

    def columns(self) -> list[list]:
        rows, self.rows, self.bytes = self.rows, [], 0
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(8)]


TYPES = [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
         ("offset", pa.int64()), ("task", pa.int64()), ("open_window", pa.int32())]


def _batch(rows: Rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(rows.columns(), TYPES)], names=[n for n, _ in TYPES])


def worker_memory(key: str) -> dict[str, dict[str, bytes]]:
    """``young`` and ``old`` words. They last as long as a Python worker, so that its next task finds the words of the one before.

    Functions travel by value and have no module of their own there, hence a module made for it.
    """
    module = sys.modules.setdefault("_threadsieve_words", types.ModuleType("_threadsieve_words"))
    return module.__dict__.setdefault(key, {"young": {}, "old": {}})


def token_ids(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Tokenizer of a vocabulary file that lowers its words, never lets them cross white space, and parts letters from marks.

    Words between blanks and line breaks, in lower ASCII letters and without a sentence mark behind them, are tokenised once and looked
    up from then on, up to a bound. Texts that may hold a special token are tokenised whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    memory = worker_memory(path)

    def look_up(words: list[str]) -> list[bytes]:
        known, old = memory["young"], memory["old"]
        if len(known) > KNOWN_WORDS:
            # words that are met again come back from the old ones, the others go with the next change
            known, old = {}, known
            memory.update(young=known, old=old)
        missing = [w for w in words if w not in known]
        new = [w for w in missing if w not in old]
        known.update({w: old[w] for w in missing if w in old})
        for i in range(0, len(new), WORDS_AT_ONCE):
            some = new[i:i + WORDS_AT_ONCE]
            known.update(zip(some, [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]))
        return [known[w] for w in words]

    def run(texts: list[str]) -> list[np.ndarray]:
        special = [i for i, t in enumerate(texts) if "<|" in t]
        column = pa.array(["" if "<|" in t else t for t in texts], pa.large_string())
        column = pc.replace_substring(pc.ascii_lower(column), "\n", " ")
        column = pc.replace_substring_regex(column, f"([{PLAIN}])([.,;:!?]) ", r"\1 \2 ")
        words = pc.split_pattern(column, " ")
        each = words.flatten().dictionary_encode()
        parts = look_up(each.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        tokens, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        at = each.indices.to_numpy()
        counts = sizes[at]
        ends = np.append(0, np.cumsum(counts))
        ids = tokens[np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        out = [ids[a:z] for a, z in zip(bounds[:-1], bounds[1:])]
        for i in special:
            out[i] = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return out

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, a bounded number of characters at a time."""
    for batch in batches:
        keys, texts, chars = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(key)
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars > CHARS_AT_ONCE:
                yield keys, texts
                keys, texts, chars = [], [], 0
        if keys:
            yield keys, texts


def _online(vocabulary: Callable[[], Callable], size: int, windows: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = vocabulary(), Packer(size, windows), Rows(0, TaskContext.get().partitionId())
        for keys, texts in _texts(batches):
            for key, ids in zip(keys, encode(texts)):
                ids = np.append(ids, np.uint32(end_id))
                rows.sequences(packer.add(Piece(key, 0, ids, len(ids))))
                if rows.bytes > BYTES_AT_ONCE:
                    yield _batch(rows)
        rows.leftovers(packer.open)
        yield _batch(rows)

    return run


def _merge(level: int, size: int, windows: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        packer, rows = Packer(size, windows), Rows(level, key[0].as_py())
        for r in group.sort_by([("task", "ascending"), ("open_window", "ascending"), ("offset", "ascending")]).to_pylist():
            rows.sequences(packer.add(Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])))
        if last:
            rows.sequences(packer.close())
        rows.leftovers(packer.open)
        return pa.Table.from_batches([_batch(rows)])

    return run


def packed(docs: DataFrame, vocabulary: Callable[[], Callable[[list[str]], list[np.ndarray]]], size: int = 2048,
           windows: int = 16, end_id: int = 1) -> DataFrame:
    """``doc_id, start, ids, doc_tokens, sequence_id, offset``: one row per piece of a document.

    ``ids`` are little-endian 32-bit numbers. ``vocabulary`` runs once per task and gives a function from texts to id
    arrays; every document ends with ``end_id``. ``size`` is a power of two. Takes ``doc_id`` and ``text``; other columns
    are ignored. A null text is empty: its only id is ``end_id``. Null and repeated ids and repeated rows are documents of their
    own. A text of any length is tokenised in sections. An empty table has no rows.

    Documents do not move: each task packs what it reads. Only its open windows, at most ``windows`` times ``size`` ids,
    are dealt again. The pieces are written once to the shared folder, since their numbers depend on the order in which tasks read.
    """
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    pieces = store(texts.mapInArrow(_online(vocabulary, size, windows, end_id), OPEN), "packed")
    names = [c.split(" ")[0] for c in PIECE.split(", ")]
    out = pieces.where("sequence_id is not null").select(*names)
    left = pieces.where("sequence_id is null")
    tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
    level = 0
    while tasks:
        level += 1
        groups = -(-tasks // TASKS_AT_ONCE)
        merge = _merge(level, size, windows, last=groups == 1)
        pieces = left.groupBy(F.floor(F.col("task") / TASKS_AT_ONCE).alias("group")).applyInArrow(merge, OPEN)
        pieces = store(pieces, "merged") if groups > 1 else pieces
        out = out.unionByName(pieces.where("sequence_id is not null").select(*names))
        left = pieces.where("sequence_id is null")
        tasks = groups if groups > 1 else 0
    return out
