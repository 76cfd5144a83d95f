"""Parallel lists packed alike, masked by whole words; phrase tables with hot and absent anchors."""

import hashlib
import random

from pyspark.sql import functions as F

from threadsieve.operators import fuzzy, lexicon, packing
from threadsieve.plans import corpus


def test_parallel_lists_are_cut_alike(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        n = rng.choice([0, 1, 3, 9, 30])
        rows.append((i % 3, i, [f"t{i}-{j}" for j in range(n)], [1] * n, [rng.choice([None, *sorted([j // 2])]) for j in range(n)], "x"))
    rows.append((0, 99, None, None, None, "x"))
    df = spark.createDataFrame(rows, "batch int, place int, ids array<string>, mask array<int>, words array<int>, tokens string")
    got = {(r.batch, r.chunk): (r.ids, r.mask, r.words) for r in packing.pack(df, ["ids", "mask", "words"], "batch", "place", 8).collect()}
    want = {}
    for b in range(3):
        lists = [[x for r in sorted(rows, key=lambda r: r[1]) if r[0] == b for x in (r[c] or [])] for c in (2, 3, 4)]
        for c in range(len(lists[0]) // 8):
            want[b, c] = tuple(part[8 * c:8 * c + 8] for part in lists)
    assert got == want and len(got) > 5


def test_masked_chunks_follow_whole_words(spark):
    words = [0, 0, 1, None, 1, 1, 0, 0, 2, 2, None, 3]
    pieces = [f"p{i}" for i in range(11)] + ["."]
    df = spark.createDataFrame([(b, pieces, words) for b in range(60)], "batch int, pieces array<string>, words array<int>")
    hits = 0
    for r in packing.mask_chunks(df, "pieces", "words", ["batch"], 0.4, 7, special=["."]).collect():
        last, n, numbers = None, -1, []
        for w in words:
            if w is not None and w != last:
                last, n = w, n + 1
            numbers.append(None if w is None else n)
        cut = format(int(0.4 * 16 ** 8), "08x")
        hit = [k is not None and hashlib.md5(f"7:{r.batch}:{k}".encode()).hexdigest()[:8] < cut and p != "." for k, p in zip(numbers, pieces)]
        assert r.pieces == ["[MASK]" if h else p for h, p in zip(hit, pieces)]
        assert r.labels == [p if h else None for h, p in zip(hit, pieces)]
        hits += sum(hit)
    assert 150 < hits < 400 and "words" not in packing.mask_chunks(df, "pieces", "words", ["batch"]).columns


def test_phrase_tables_of_each_kind(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "a", "zebra", "quick", "foxes", "Übermaß", "x1", "end"]
    texts = [". ".join(" ".join(rng.choices(words, [9, 5, 1, 2, 2, 1, 1, 1], k=rng.randint(1, 7))).capitalize() for _ in range(5)) + rng.choice([".", "?!", ""])
             for _ in range(60)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (7, texts[7])]
    df = spark.createDataFrame(rows, "snapshot_id long, email string")
    keyed = df.withColumn("snapshot_id", F.coalesce("snapshot_id", F.xxhash64("email")))
    for listed in (["quick the foxes"], ["the the the", "a zebra", "absent one here"], ["oxe"], ["?!"], ["the the the", "zeb", "?", "x1 end"], [], [""]):
        table = spark.createDataFrame([(p,) for p in listed], "phrase string")
        want = {}
        for r in keyed.select("snapshot_id", "email", F.split(F.lit(""), "").alias("z")).collect():
            want.setdefault(r.snapshot_id, r.email)
        for searched in (1000, 0):
            monkeypatch.setattr(lexicon, "SEARCHED", searched)
            got = {r.snapshot_id: r.email for r in lexicon.remove_phrase_table(keyed, table).collect()}
            from threadsieve.functions import text as tx
            plain = {r.snapshot_id: r.email for r in keyed.withColumn("email", tx.remove_phrases(F.col("email"), [p for p in listed if p])).collect()}
            assert got == plain, listed


def test_phrase_sets_decide_as_the_plain_similarity():
    rng = random.Random(2)
    words = ["terms", "and", "conditions", "apply", "condition", "term", "aply", "all", "rights", "reserved", "right", "a", "b1", "x_y"]
    phrases = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)] + ["", "!!", "colour", "Terms, and conditions apply"]
    for threshold in (90.0, 75.0, 100.0):
        sets, hits = fuzzy.PhraseSets.of(phrases), 0
        for _ in range(1500):
            s = " ".join(rng.choices([*words, "é", "...", "color", "TERMS"], k=rng.randint(0, 6)))
            plain = any(round(fuzzy.token_set_similarity(fuzzy.plain_words(s), fuzzy.plain_words(p))) >= threshold for p in phrases)
            assert sets.similar(s, threshold) == plain, (s, threshold)
            hits += plain
        assert 0 < hits < 1500


def test_splits_are_balanced_by_their_own_ratios(spark):
    rows = [(i, kind, int(i % 10 == 0)) for i, kind in enumerate(["train", "val", "test"] * 40)]
    df = spark.createDataFrame(rows, "snapshot_id long, data_type string, target int")
    counts = df.groupBy("data_type", "target").count().collect()
    own = {(r.data_type, r.target): r["count"] for r in counts}
    for ratio, val_ratio, want in ((5, 20, (5, 20)), (5, "same", (5, 5)), (None, 2, (None, 2)), (3, None, (3, None)), (None, None, (None, None))):
        got = {(r.data_type, r.target): r["count"] for r in corpus.balance(df, ratio, val_ratio=val_ratio).groupBy("data_type", "target").count().collect()}
        for kind, wanted in zip(("train", "val"), want):
            assert got[kind, 1] == own[kind, 1]
            assert got[kind, 0] == (own[kind, 0] if wanted is None else wanted * own[kind, 1])
        assert all(got["test", t] == own["test", t] for t in (0, 1))


def test_short_phrases_meet_words_that_end_where_they_go_on(spark, monkeypatch):
    texts = ["An end. Endless bend", "the end", "Bend the ending. x", "un-end.ed", "to end it. So be it.", "bend. It", None]
    df = spark.createDataFrame(list(enumerate(texts)), "snapshot_id long, email string")
    listed = ["end.", "end", "the end", "-end", "end it.", "end end", "it."]
    kept, plain = {}, lexicon.store
    monkeypatch.setattr(lexicon, "store", lambda d, purpose: kept.setdefault(purpose, plain(d, purpose)))
    found = lexicon.remove_phrase_table(df, spark.createDataFrame([(p,) for p in listed], "phrase string"))
    from threadsieve.functions import text as tx
    want = df.withColumn("email", tx.remove_phrases(F.col("email"), listed))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    met = {}
    for r in kept["within"].collect():
        met.setdefault(r.phrase, set()).add(r.word)
    words = {"end", "endless", "bend", "ending"}
    assert met["end"] == met["end end"] == words and met["end."] == {"end", "bend"} and met["-end"] == {"end", "endless", "ending"}
    assert met["the end"] == {"end", "endless", "ending"} and met["end it."] == {"end", "bend"} and met["it."] == {"it"}
