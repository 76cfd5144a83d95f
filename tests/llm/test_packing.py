"""Bounded-space packing: every id once, full windows, powers of two at the end."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadsieve.llm import packing
from threadsieve.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def letters():
    """A toy vocabulary: an id for each character."""
    return lambda texts: [np.array([ord(c) + 2 for c in t], "<u4") for t in texts]


def check(rows, texts, size, encode, end_id=1):
    """The pieces of each document, in order, are its ids; sequences have no gap and are full or powers of two."""
    docs, sequences = {}, {}
    for r in rows:
        ids = list(np.frombuffer(bytes(r.ids), "<u4"))
        docs.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, len(ids)))
        assert ids
    want = {k: list(encode([t or ""])[0]) + [end_id] for k, t in texts.items()}
    assert set(docs) == set(want)
    for key, pieces in docs.items():
        pieces.sort(key=lambda p: p[0])
        got = []
        for start, ids, total in pieces:
            assert start == len(got) and total == len(want[key])
            got += ids
        assert got == want[key]
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size and at & (at - 1) == 0
    short = [sum(n for _, n in parts) for parts in sequences.values()]
    assert len(set(n for n in short if n < size)) == len([n for n in short if n < size])


@pytest.mark.parametrize("partitions", [1, 7, 150])
def test_all_ids_lie_in_full_sequences(spark, partitions):
    rng = random.Random(partitions)
    texts = {i: "".join(rng.choices("abc", k=rng.choice([0, 1, 5, 40, 64, 63, 200, 700]))) for i in range(600)}
    texts[7], texts[8] = None, ""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(partitions)
    rows = packing.packed(docs, letters, size=64, windows=4).collect()
    check(rows, texts, 64, letters())


def test_best_fit_and_fullest():
    piece = lambda key, n: packing.Piece(key, 0, np.zeros(n, "<u4"), n)
    packer = packing.Packer(16, 2)
    assert packer.add(piece("a", 10)) == [] and packer.add(piece("b", 13)) == []
    assert packer.add(piece("c", 2)) == []  # best fit: beside b, which has 3 free
    assert [w.free for w in packer.open] == [6, 1]
    done = packer.add(piece("d", 9))  # fits nowhere: the fullest is filled and emitted, the tail opens a window
    assert [[(p.doc_id, p.start, len(p.ids)) for p in s] for s in done] == [[("b", 0, 13), ("c", 0, 2), ("d", 0, 1)]]
    assert [w.free for w in packer.open] == [6, 8]
    done = packer.add(piece("e", 35))  # two full windows, then the rest
    assert [len(s[0].ids) for s in done] == [16, 16] and sorted(w.free for w in packer.open) == [3, 8]
    done = packer.close()
    assert [sum(len(p.ids) for p in s) for s in done] == [16, 4, 1]


def test_nulls_repeats_other_columns_and_empty_table(spark):
    rows = [(None, "ab", "x"), (None, "ab", "x"), (3, None, "y"), (3, "abc", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = packing.packed(docs, letters, size=8).collect()
    assert sum(len(r.ids) // 4 for r in got) == 3 + 3 + 1 + 4
    assert sorted((r.doc_id is None, r.doc_tokens) for r in got if r.start == 0) == [(False, 1), (False, 4), (True, 3), (True, 3)]
    assert packing.packed(docs.where("false"), letters).count() == 0


def test_long_text():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdeé'\u0301!1.", k=rng.randint(1, 9))) for _ in range(400_000))
    got = packing.token_ids(PATH)([text, "", text[:99]])
    plain = Tokenizer.from_file(PATH)
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in (text, "", text[:99])]


def test_words_are_looked_up_as_the_tokenizer_reads_them(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 300)
    rng = random.Random(9)
    parts = ["Word", "word", "it's", "DON'T", "a.b", "x..", "x.", "²!", "Ⅷ?", "é,", "É", "e\u0301.", "\u0301", "Σας.", "ΟΔΟΣ", "_:", "5;", "42,",
             "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>.", "\x1c", "a\x1cb", "\u00a0", "b\u2003c", "\u0085", "日本。", "日,", "😀!", "\t", "\r"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "  ", "", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    encode, plain = packing.token_ids(PATH), Tokenizer.from_file(PATH)
    got = [ids.tolist() for at in range(0, 400, 50) for ids in encode(texts[at:at + 50])]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_query_against_the_tokenizer(spark, sf):
    plain = Tokenizer.from_file(PATH)
    want = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1]
            for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_packing"](spark, sf).collect()
    filled = {}
    total = dict.fromkeys(want, 0)
    for r in rows:
        ids = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
        total[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == {k: len(v) for k, v in want.items()}
    for parts in filled.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
    assert sum(n for v in filled.values() for _, n in v) == sum(len(v) for v in want.values())
