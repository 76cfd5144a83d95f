"""Paragraph table against all pairs, on word counts and on supplied vectors."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadsieve.operators import paragraphs


def all_pairs(text, separator="\n", threshold=0.98):
    parts = text.split(separator)
    counts = [Counter(re.findall("[a-z0-9_]+", p.lower())) for p in parts]

    def similar(a, b):
        dot, na, nb = (float(sum(n * y[w] for w, n in x.items())) for x, y in ((a, b), (a, a), (b, b)))
        return dot > 0 and dot * dot > threshold * threshold * na * nb

    return separator.join(p for i, p in enumerate(parts) if not any(similar(counts[i], b) for b in counts[i + 1:]))


def texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    out = []
    for n in (0, 1, 2, 5, 40, 70, 200):
        lines = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 8, 60]))) for _ in range(n)]
        for _ in range(n // 2):
            line = rng.choice(lines).split()
            rng.shuffle(line)
            lines.append(" ".join(line + rng.choices(words, k=rng.choice([0, 0, 1]))))
        out.append("\n".join(lines))
    # one mass of near copies, and one that is alike though not enough
    base = rng.choices(words, k=120)
    out.append("\n".join(" ".join([*base, rng.choice(words)]) for _ in range(150)))
    out.append("\n".join(" ".join([*base[:60], *rng.choices(words, k=12)]) for _ in range(150)))
    return out


@pytest.mark.parametrize("in_row", [0, 64])
def test_paragraphs_equal_all_pairs(spark, in_row):
    rows = [(i, t, "x") for i, t in enumerate([*texts(), None, "", "\n\n", texts()[5]])]
    df = spark.createDataFrame(rows, "id long, email string, place string")
    got = {r.id: r.email for r in paragraphs.drop_similar_paragraphs(df, separator="\n", in_row=in_row).collect()}
    assert got == {i: t if t is None else all_pairs(t) for i, t, _ in rows}


def test_many_paragraphs_of_one_text_are_spread(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    lines = [" ".join(rng.choices(words, k=30)) for _ in range(14_000)]
    twins = [" ".join(rng.sample(w := line.split(), len(w))) for line in rng.sample(lines, 6000)]
    lines += twins
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text)], "id long, email string")
    got = paragraphs.drop_similar_paragraphs(df, separator="\n").first().email.split("\n")
    last = {tuple(sorted(line.split())): i for i, line in enumerate(lines)}
    assert got == [line for i, line in enumerate(lines) if last[tuple(sorted(line.split()))] == i]


def test_supplied_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for doc in range(3):
        base = rng.normal(size=(40, 16))
        near = base[rng.integers(0, 40, 60)] + rng.normal(size=(60, 16)) * rng.choice([0.0, 0.1, 0.25], size=(60, 1))
        rows += [(doc, i, [float(x) for x in v * s]) for i, (v, s) in enumerate(zip(np.vstack([base, near]), rng.random(100) + 0.5))]
    rows += [(7, 0, [0.0] * 16), (7, 1, [0.0] * 16), (7, 2, None), (None, 1, [1.0] * 16), (None, 2, [1.0] * 16), (8, None, [1.0] * 16),
             (9, 0, [-x for x in rows[0][2]]), (9, 1, rows[0][2])]
    df = spark.createDataFrame(rows, "d long, n long, v array<double>")
    got = {(r.d, r.n) for r in paragraphs.drop_similar_vectors(df, "d", "n", "v").collect()}
    want = set()
    for d, n, v in rows:
        later = [np.array(w) for e, m, w in rows if e == d and d is not None and n is not None and m is not None and m > n and w is not None]
        a = None if v is None else np.array(v)
        if a is None or not any(a @ b > 0 and (a @ b) ** 2 > 0.98 * 0.98 * (a @ a) * (b @ b) for b in later):
            want.add((d, n))
    assert got == want and len(got) < len(rows)


def test_rounds_go_on_until_none_is_left(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "FIRST_ROUND", 1)
    monkeypatch.setattr(paragraphs, "GROWTH", 2)
    df = spark.createDataFrame(list(enumerate(texts())), "id long, email string")
    got = {r.id: r.email for r in paragraphs.drop_similar_paragraphs(df, separator="\n", in_row=3).collect()}
    assert got == {i: all_pairs(t) for i, t in enumerate(texts())}


def test_thresholds_and_empty_table(spark):
    df = spark.createDataFrame([], "id long, email string")
    assert paragraphs.drop_similar_paragraphs(df).count() == 0
    with pytest.raises(ValueError):
        paragraphs.superseded(df.select(F.lit(1).alias("doc"), F.lit(1).alias("place")), 0.9)


def test_pairs_of_a_large_document_grow_with_its_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    compared, store = [], paragraphs.store

    def counted(df, purpose):
        out = store(df, purpose)
        if purpose == "blocks":
            sizes = out.groupBy("doc", "block").agg(F.max("size").alias("n"))
            compared.append(sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0])
        return out

    monkeypatch.setattr(paragraphs, "store", counted)
    n = 8000
    base = rng.normal(size=(n, 24))
    base[: n // 20] = base[-(n // 20):] + rng.normal(size=(n // 20, 24)) * 0.1
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(base)], "d long, n long, v array<double>").repartition(4)
    got = {r.n for r in paragraphs.drop_similar_vectors(df, "d", "n", "v").select("n").collect()}
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    similar = np.triu(unit @ unit.T > 0.98, 1).any(1)
    assert got == set(np.flatnonzero(~similar).tolist()) and similar.sum() > n // 25
    # blocks of 12 bits have 818,452 pairs here
    assert compared[0] < 40 * n


def test_levels_miss_no_more_than_the_first():
    miss = {b: (1 - paragraphs._SIDE**b) ** n for b, n in paragraphs.LEVELS.items()}
    assert paragraphs.LEVELS[paragraphs.BITS] == paragraphs.BANDS and max(miss.values()) == miss[paragraphs.BITS] < 4e-11
    ids = np.tile(np.arange(16), 30)
    values, sizes = np.random.default_rng(6).normal(size=480), np.full(30, 16)
    for bits, bands in paragraphs.LEVELS.items():
        numbers = paragraphs.block_numbers(ids, values, sizes, bits)
        assert numbers.shape == (30, bands) and (numbers >> bits == np.arange(bands)).all()
        # vectors over different ids take the other way to the same numbers
        apart = np.concatenate([ids, np.arange(1000, 1200)]), np.concatenate([values, np.ones(200)]), np.append(sizes, 200)
        assert (paragraphs.block_numbers(*apart, bits)[:30] != numbers).mean() < 0.01
