"""1- and 2-grams counted in batches against a plain count."""

from collections import Counter

from threadsieve.operators import tfidf

TEXTS = [None, "", "one", "Aa bb aa BB aa", "x y zz", "aa bb, cc aa bb", "Été à cd cd", "aa bb aa BB aa"]


def plain(text):
    words = [w for w in (text or "").lower().replace(",", " ").split() if len(w) > 1]
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


def test_grams_equal_a_plain_count(spark, monkeypatch):
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(TEXTS)], "id long, t string").coalesce(1)
    want = Counter((i % 5, g, n) for i, t in enumerate(TEXTS) for g, n in plain(t).items())
    counts = tfidf.term_counts(df, "t", "id")
    assert Counter(map(tuple, counts.collect())) == want
    sums = {r.term: (r.tf, r.df) for r in tfidf.vocabulary(df, "t", 1, 1.0, None, row_id="id").collect()}
    assert sums == {g: (sum(plain(t)[g] for t in TEXTS), sum(g in plain(t) for t in TEXTS)) for t in TEXTS for g in plain(t)}
    # the words of a text are made once
    for made in (counts, tfidf.vocabulary(df, "t", 1, 1.0, None, row_id="id")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_batches_of_rows_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c")], "id long, t string")
    assert tfidf.term_counts(df, "t", "id").collect() == []
