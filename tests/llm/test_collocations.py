"""Quotient filters as exact counters, and phrases against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from threadsieve.llm import collocations, quotient


@pytest.mark.parametrize("words, width", [(2, 1), (2, 3), (3, 5), (2, 16), (4, 16), (5, 16), (5, 25), (3, 21)])
@pytest.mark.parametrize("shard_bits", [0, 3])
def test_filters_give_every_ngram_and_count_back(words, width, shard_bits):
    half = quotient.half_bits(words, width)
    shard_bits = min(shard_bits, half)
    rng = np.random.default_rng(words * 100 + width)
    ids = [rng.integers(0, 1 << width, 3000).astype(np.uint64) for _ in range(words)]
    counts = np.maximum(rng.integers(1, 1 << 40, 3000) >> rng.integers(0, 40, 3000), 1).astype(np.uint64)
    want = collections.Counter()
    for *gram, n in zip(*[c.tolist() for c in ids], counts.tolist()):
        want[tuple(gram)] += n
    parts = collections.defaultdict(list)
    for some in np.array_split(np.arange(3000), 4):  # four tasks, each with filters of its own
        keys = quotient.permute(*quotient.pack([c[some] for c in ids], width), half)
        for shard, data in quotient.shards(*quotient.counted(*keys, counts[some], half), half, shard_bits):
            parts[shard].append(data)
    got = {}
    for shard, data in parts.items():
        one = quotient.merged(data)
        assert (one.high >> np.uint64(half - shard_bits) == shard).all() and one.holds(one.high, one.low).all()
        back = quotient.unpack(*quotient.restore(one.high, one.low, half), words, width)
        got.update({tuple(g): n for *g, n in zip(*[c.tolist() for c in back], one.counts.tolist())})
        again = quotient.Filter.from_bytes(one.to_bytes())
        assert all((getattr(again, c) == getattr(one, c)).all() for c in ("high", "low", "counts"))
    assert got == dict(want)


def test_lookups_miss_what_was_not_counted():
    half = quotient.half_bits(5, 16)
    ids = [np.arange(500, dtype=np.uint64) * np.uint64(k + 1) % np.uint64(1 << 16) for k in range(5)]
    keys = quotient.permute(*quotient.pack(ids, 16), half)
    held = quotient.Filter(*quotient.counted(*[k[::2] for k in keys], np.ones(250, np.uint64), half), half)
    assert held.holds(*keys).tolist() == [True, False] * 250
    # entries that share the high half
    high, low = np.array([7, 7, 7, 9], np.uint64), np.array([1, 4, 6, 1], np.uint64)
    held = quotient.Filter(high, low, np.ones(4, np.uint64), half)
    assert held.holds(np.array([7, 7, 7, 9, 9, 8], np.uint64), np.array([4, 5, 6, 1, 4, 1], np.uint64)).tolist() == [
        True, False, True, True, False, False]
    empty = quotient.Filter(high[:0], low[:0], low[:0], half)
    assert not empty.holds(high, low).any() and len(quotient.Filter.from_bytes(empty.to_bytes()).high) == 0


def test_too_many_ids_are_refused():
    with pytest.raises(ValueError):
        quotient.half_bits(5, 26)


def plain(rows, least, longest, covered, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    often = {g: c for g, c in f.items() if c >= least and len(g[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, g), a in often.items():
        if any(o == lang and len(h) > len(g) and 100 * c >= covered * a and any(h[i:i + len(g)] == g for i in range(len(h)))
               for (o, h), c in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
            for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def fixture():
    rng = random.Random(4)
    names = ["the", "of", "New", "york", "a", "é", "Ünder", " x", "b\x1fc", "z", "q" * 40, "日本"]
    rows = []
    for i in range(120):
        words = rng.choices(names, [9, 6, 4, 4, 5, 2, 2, 1, 1, 3, 1, 1], k=rng.randint(0, 60))
        text = "".join(w + rng.choices([" ", "  ", "\t", ", ", "\n", "!", ";"], [30, 2, 2, 2, 1, 1, 1])[0] for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    rows += [("en", "new york city hall " * 3000), ("en", None), (None, ""), ("fr", "a a a a a a"), ("fr", " \t. ,")]
    return rows + rows[:30]


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
@pytest.mark.parametrize("least, covered, top", [(4, 100, 2000), (2, 60, 7)])
def test_against_plain_counting(spark, monkeypatch, sent_bytes, least, covered, top):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate(rows)], "ids long, text string, lang string, f int")
    got = collocations.collocations(docs.repartition(5), least=least, covered=covered, top=top, sent_bytes=sent_bytes).collect()
    want = plain(rows, least, 5, covered, top)
    assert len(want) > 20 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_small_buffers_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "GATHER", 50)
    monkeypatch.setattr(collocations, "KEEP", 20)
    monkeypatch.setattr(collocations, "WORDS_AT_ONCE", 37)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 100)
    rows = fixture()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(docs, least=3).collect()
    assert {tuple(r) for r in got} == plain(rows, 3, 5, 100, 2000)


def test_digest_clash_takes_the_next_seed(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "a b a b c")], "lang string, text string")
    words, _, seed = collocations.vocabulary(docs, 2)
    assert seed == 1 and sorted((r.word, r.f) for r in words.collect()) == [("a", 2), ("b", 2)]
    assert sorted(r.id for r in words.collect()) == [1, 2]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    rare = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert collocations.collocations(rare).count() == 0
