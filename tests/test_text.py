"""Text functions on literal cases."""

import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadsieve.functions import text as tx
from threadsieve.functions.tokens import token_length
from threadsieve.operators import fuzzy, lexicon


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


CLEAN = [
    ("Hello <b>World</b>", "hello world"),
    ("line_x000D_ break", "line break"),
    ("zero‌\xa0width", "zerowidth"),
    ("a" * 20 + " " + "b" * 21, "a" * 20),
    ("really. . . . gotcha", "really . gotcha"),
    ("meet 12 main street springfield 12345 later", "meet later"),
    ("the end.Next day", "day"),
    ("costs 3.50 dollars", "costs dollars"),
    ("mail a.b@c.com please", "mail please"),
    ("call 555-123-4567 today", "call today"),
    ("room 42 b", "room b"),
    ("it's the user's call", "it's user's call"),
    ("", ""),
    (None, ""),
]


def test_clean_cases(spark):
    got = apply(spark, [c[0] for c in CLEAN], tx.clean)
    want = [c[1] for c in CLEAN]
    assert got == want


SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0      　"


def test_white_space_is_that_of_python(spark):
    values = [f"a{c}b" for c in SPACES] + ["a​b", "a᠎b"]
    assert apply(spark, values, tx.word_count) == [len(v.split()) for v in values]


def python_rewrite(text):
    """The cleaning rules (fixed values) one after another, by the Python engine."""
    t = text.lower()
    for p in (r"<[^>]*>", "_x000d_", "‌\xa0+", r"[^A-Za-z\s\d+/.:\-,;?'\"%$]"):
        t = re.sub(p, "", t)
    t = " ".join(w for w in t.split() if len(w) <= 20)
    for p in (r"(\s\.){2,}", r"\d+\s+[a-zA-Z0-9\s,]+\s+[a-zA-Z]+\s+\d{5}"):
        t = re.sub(p, "", t)
    t = re.sub(tx.URL, "", t)
    return re.sub(r"\(?\d{3}\)?[.\-\s]?\d{3}[.\-\s]?\d{4}", "", t)


ALPHABET = st.text(alphabet="abcdefgXYZ0123456789 .,:/-'<>_()@é`\t\n\xa0‌", max_size=120)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ALPHABET, min_size=40, max_size=60))
def test_rewrite_equals_python_rules(spark, values):
    assert apply(spark, values, tx.rewrite) == [python_rewrite(v) for v in values]


def test_rewrite_of_documents_equals_python_rules(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", tx.rewrite(F.col("text")).alias("x")).collect()
    assert [r.x for r in rows] == [python_rewrite(r.text) for r in rows]


def test_long_runs_do_not_overflow(spark):
    values = [" ." * 100_000, "1 " * 100_000, "a.b " * 50_000, "x" * 300_000, "_1_" * 50_000, "<" * 100_000,
              " " * 100_000 + "x", "1 a " * 50_000 + "x 12345", "1  a\n" * 50_000]
    assert len(apply(spark, values, tx.clean)) == len(values)
    assert len(apply(spark, values, tx.remove_layout)) == len(values)
    assert len(apply(spark, values, tx.bag_of_words)) == len(values)


def test_clean_is_stable(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(tx.clean(F.col("text")).alias("a"))
    outside = df.where(F.col("a").rlike(r"[^A-Za-z \p{Nd}+/.:\-,;?'\"%$]"))
    assert outside.count() == 0


def test_quotes(spark):
    assert apply(spark, ["it`s ’ok’"], tx.normalise_quotes) == ["it's 'ok'"]


def test_quote_marks(spark):
    assert apply(spark, ["> a \n>> b\n c"], tx.strip_quote_marks) == ["a\n> b\nc"]


def test_layout(spark):
    body = "one two three four five six seven eight nine ten"
    text = "\n\n".join([
        "From: someone " + body, body, "too short", body + " call 555-123-4567",
        body + " 12 main street town 12345", "Subject: x",
    ])
    assert apply(spark, [text], tx.remove_layout) == [body]


def test_paragraphs_and_lines(spark):
    assert apply(spark, ["a\n\nb\n\na\n\nc"], tx.dedup_paragraphs) == ["a\n\nb\n\nc"]
    long = " ".join("abcdefghij")
    assert apply(spark, [f"x y\n\n\n{long}\nz"], tx.remove_short_lines) == [long]


def test_phrases(spark):
    text = "Hello there. All Rights Reserved. All rights reserved by us. See you! 1.5 a"
    assert apply(spark, [text], tx.remove_phrases) == ["Hello there. See you! 1.5 a"]
    # A phrase is literal by default: its dot is a dot.
    assert apply(spark, ["a1b c. d"], lambda c: tx.remove_phrases(c, ["a.b"])) == ["a1b c. d"]
    assert apply(spark, ["a1b c. d"], lambda c: tx.remove_phrases(c, ["a.b"], regex=True)) == ["d"]
    assert apply(spark, ["a. b"], lambda c: tx.remove_phrases(c, [])) == ["a. b"]


def test_phrase_table_with_short_and_long_phrases(spark):
    df = spark.createDataFrame([
        (1, "Keep me. Please UNSUBSCRIBE now. Xterms and conditions applyx here. Bye."), (2, "gone away"), (3, None),
    ], "snapshot_id long, email string")
    phrases = spark.createDataFrame([("unsubscribe",), ("terms and conditions apply",), ("gone away",), ("",)], "phrase string")
    got = {r.snapshot_id: r.email for r in lexicon.remove_phrase_table(df, phrases).collect()}
    assert got == {1: "Keep me. Bye.", 2: "", 3: None}


def test_phrase_table_has_no_limit_on_short_phrases(spark):
    said = [f"Word{i} says number{i * 7}{' ~~' if i % 11 == 0 else ''} ok." for i in range(400)]
    rows = [(None if i % 5 == 0 else i, f"{a} {b}") for i, (a, b) in enumerate(zip(said[::2], said[1::2], strict=True))]
    listed = [f"ber{i}" for i in range(1000, 5000, 2)] + [f"d{i} s" for i in range(0, 6000, 3)] + [f"{i} ok" for i in range(7, 9000, 9)] + ["~~"]
    assert len(listed) > 5000 - 10
    df = spark.createDataFrame(rows, "snapshot_id long, email string")
    got = sorted(r.email for r in lexicon.remove_phrase_table(df, spark.createDataFrame([(p,) for p in listed], "phrase string")).collect())
    sentences = [[s for s in (said[2 * i], said[2 * i + 1]) if not any(p in s.lower() for p in listed)] for i in range(200)]
    assert got == sorted(" ".join(s) for s in sentences)


def test_null_ids_keep_their_dictionary_words(spark):
    df = spark.createDataFrame([(None, "alpha beta"), (1, "beta gamma")], "snapshot_id long, email string")
    words = spark.createDataFrame([("alpha",), ("gamma",)], "word string")
    assert {r.email for r in lexicon.keep_dictionary_words(df, "email", words).collect()} == {"alpha", "gamma"}


def test_tokens(spark):
    assert apply(spark, ["don't stop, a_b!!"], tx.tokenize) == [["don't", "stop", ",", "a_b", "!", "!"]]
    assert apply(spark, ["don't!!"], tx.tokenize_word_punct) == [["don", "'", "t", "!!"]]
    kept = apply(spark, ["The cat and THE cat"], lambda c: tx.without_stop_words(tx.tokenize(c)))
    assert kept == [["cat", "cat"]]
    assert apply(spark, ["the a"], lambda c: tx.without_stop_words(tx.tokenize(c), None)) == [["the", "a"]]
    assert apply(spark, ["The 3 big_dogs, ran!"], tx.bag_of_words) == ["bigdogs ran"]
    assert apply(spark, ["Été à b cd cd"], lambda c: tx.with_bigrams(tx.terms(c))) == [
        ["été", "cd", "cd", "été cd", "cd cd"]]


def test_run_lengths(spark):
    values = ["b a b c a b", "", "x"]
    got = apply(spark, values, lambda c: tx.run_lengths(F.filter(F.split(c, " "), lambda w: w != "")))
    assert [[(e.term, e.n) for e in row] for row in got] == [[("a", 2), ("b", 3), ("c", 1)], [], [("x", 1)]]


def brute_similar(text, sep="\n\n", threshold=0.98):
    parts = text.split(sep)
    vectors = [Counter(re.findall(r"\w+", p.lower())) for p in parts]

    def cosine(a, b):
        n = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(a[k] * b[k] for k in a) / n if n else 0.0

    gone = [any(cosine(vectors[i], vectors[j]) > threshold for j in range(i + 1, len(parts))) for i in range(len(parts))]
    return sep.join(p for p, g in zip(parts, gone) if not g)


WORDS = st.lists(st.sampled_from("red green blue longword tiny".split()), max_size=40).map(" ".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, min_size=1, max_size=6).map("\n\n".join), min_size=20, max_size=30))
def test_similar_paragraphs_equal_brute_force(spark, texts):
    assert apply(spark, texts, tx.dedup_similar_paragraphs) == [brute_similar(t) for t in texts]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_indel_similarity(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert fuzzy.indel_similarity(a, b) == pytest.approx(want)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=24), st.text("abc ", max_size=24))
def test_token_set_similarity(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        want = 0.0
    else:
        both = " ".join(sorted(x & y))
        left = (both + " " + " ".join(sorted(x - y))).strip()
        right = (both + " " + " ".join(sorted(y - x))).strip()
        pairs = [(left, right)] + ([(both, left), (both, right)] if both else [])
        want = max(200.0 * lcs(p, r) / (len(p) + len(r)) for p, r in pairs)
    got = fuzzy.token_set_similarity(a, b)
    assert got == pytest.approx(want, abs=1e-9) or (got <= want and (x & y) and got >= want - 10)


def test_fuzzy_phrases(spark):
    df = spark.createDataFrame([(1, "Hello you. All rights are reserved. rights reserved all. Bye now.")], "id int, email string")
    got = fuzzy.remove_similar_phrases(df, ["all rights reserved"]).first().email
    assert got == "Hello you. Bye now."


def test_token_length(spark):
    got = apply(spark, ["a b", None, ""], lambda c: token_length(c, lambda: lambda ts: [len(t.split()) for t in ts]))
    assert got == [2, 0, 0]
