"""Operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadsieve.llm import chat, decontamination, langid, lines, mixing, neardup, quality, sharding, suffixes, toxicity
from threadsieve.llm.common import BATCH, BATCH_BYTES
from threadsieve.llm.samples import per_class
from threadsieve.llm.words import pieces, shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, row string, size long, _digest long, stratum string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2, "y") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(12)]
    out = []
    for n in range(60):
        words = list(base[n % 12])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        lined = [" ".join(words[i : i + 12]) for i in range(0, 120, 12)]
        out.append((n, "\n".join(lined), rng.choice(["en", "fr", None]), rng.choice(["b", "a", None])))
    long = " ".join(rng.choice(vocabulary) for _ in range(40_000))
    out += [(100, None, "en", "a"), (101, "", "fr", None), (102, " \t\n", None, "a"), (103, "Über ÉA b", "en", "a"),
            (None, out[3][1], "en", "b"), (104, long, "en", "b"), out[5], out[5], (105, "a b\na b", "fr", "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, rows, empty):
    got = neardup.near_duplicates(docs, 85).collect()
    sets = [shingle_set(t) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    want = Counter((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(empty, 85).count() == 0
    one = neardup.one_of_each(docs, 85)
    assert one.columns == docs.columns
    assert one.count() == len({c for _, n, c in want if n}) + sum(not s for s in sets)


def test_near_copies_of_a_hub_lose_no_link(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for n in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(0, 150, 9)] = f"x{rng.randrange(3)}"
        texts.append((n, " ".join(words), "en", "a"))
    sets = [shingle_set(t) for _, t, _, _ in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(make(spark, texts), 85).collect()}
    assert got == dict(enumerate(label))


def test_unlinked_documents_of_one_id_all_stay(spark):
    rng = random.Random(2)
    own = [" ".join(f"v{rng.randrange(10_000)}" for _ in range(80)) for _ in range(8)]
    ids = [7, 7, None, None, None, 8, 9, 9]
    # near copies of a text under id 7, of one under a null id, and of one under id 8 that has the other's id 7
    rows = list(zip(ids, own, strict=True)) + [(7, own[0] + " more"), (None, own[2] + " more"), (7, own[5] + " more"), (9, own[6])]
    table = make(spark, [(i, t, "en", "a") for i, t in rows])
    got = Counter((r.doc_id, r.text) for r in neardup.one_of_each(table, 80).collect())
    texts = Counter(next(n for n, t in enumerate(own) if text.startswith(t)) for _, text in got.elements())
    assert texts == Counter(range(8))
    assert (7, own[5] + " more") in got and (8, own[5]) not in got


def test_wide_rows_of_kept_documents_are_shuffled_once(spark):
    docs = make(spark, [(i if i % 4 else None, " ".join(f"w{i % 30}x{j}" for j in range(9)), "en", None) for i in range(90)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.one_of_each(docs, 80)
        plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
        assert len({r.text for r in kept.collect()}) == kept.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert sum("row#" in columns for columns in moved) == 1


def test_signatures_estimate_similarity():
    a, b = " ".join(f"w{i}" for i in range(204)), " ".join(f"w{i}" for i in range(20, 224))
    (h, bounds), = [shingle_sets(p, 5) for p in pieces(pa.array([a, b]))]
    s = neardup.signatures(h, bounds)
    assert abs((s[0] == s[1]).mean() - 180 / 220) < 0.12


@pytest.mark.parametrize("length", [3, 5])
def test_transform(length):
    rng = np.random.default_rng(0)
    for _ in range(30):
        strings = [rng.integers(97, 100, rng.integers(0, 30)).astype(np.uint8) for _ in range(rng.integers(1, 6))]
        seen = Counter(bytes(s[i : i + length]) for s in strings for i in range(len(s) - length + 1))
        for s, flags in zip(strings, suffixes.repeated_places(strings, length), strict=True):
            assert flags.tolist() == [seen[bytes(s[i : i + length])] > 1 for i in range(max(0, len(s) - length + 1))]


def test_transform_is_that_of_the_sorted_suffixes():
    strings = [np.frombuffer(s, np.uint8) for s in (b"banana", b"ananas", b"nab")]
    bwt, lcp = suffixes.transform(strings)
    order = sorted((bytes(s[i:]) + b"\0" * 0, n, i) for n, s in enumerate(strings) for i in range(len(s) + 1))
    order.sort(key=lambda x: ([*x[0], -1], x[1]))
    code = {b: i + 1 for i, b in enumerate(sorted(set(b"bananas")))}
    assert Counter(bwt.tolist()) == Counter(code[strings[n][i - 1]] if i else 0 for _, n, i in order)
    assert lcp.max() == 5


def test_suffix_deduplication(spark, docs, rows, empty):
    got = suffixes.without_repeats(docs).collect()
    data = [(t or "").encode() for _, t, _, _ in rows]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    want = Counter()
    for (doc, *_), b in zip(rows, data):
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                cover[i] += 1
                cover[i + 400] -= 1
        cover = np.cumsum(cover[:-1]) > 0
        want[doc, len(b), int(cover.sum()), np.frombuffer(b, np.uint8)[~cover].tobytes()] += 1
    assert Counter((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), bytes(r.kept)) for r in got) == want
    assert suffixes.without_repeats(empty).count() == 0


def test_places_counted_one_by_one(docs, monkeypatch):
    want = Counter((r.doc_id, bytes(r.kept)) for r in suffixes.without_repeats(docs).collect())
    monkeypatch.setattr(suffixes, "MOST", 1)
    assert Counter((r.doc_id, bytes(r.kept)) for r in suffixes.without_repeats(docs).collect()) == want


@pytest.fixture
def long_texts(spark):
    """40 MB of text whose rows give Arrow batches of 10 MB and more on 8 cores; the session's batch size as Spark has it."""
    spark.conf.unset(BATCH)
    words = F.concat_ws(" ", "id", F.repeat(F.lit("some more words "), 1250))
    yield spark.range(2000).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source")).coalesce(1)
    spark.conf.unset(BATCH)


def test_batches_of_language_are_small(long_texts, monkeypatch):
    def told(model, gap):
        def run(batches):
            for b in batches:
                n = len(b)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([str(b.nbytes)] * n), pa.array([0.0] * n), pa.array([False] * n)],
                                                 names=["row", "lang_pred", "score", "ambiguous"])
        return run

    monkeypatch.setattr(langid, "_predict", told)
    got = [int(r.lang_pred) for r in langid.identify(long_texts, None).select("lang_pred").collect()]
    assert len(got) == 2000 and max(got) < BATCH_BYTES + 100_000


def test_batches_of_lines_are_small(long_texts, monkeypatch):
    def told(min_words):
        def run(batches):
            for b in batches:
                size, zero = pa.array([b.nbytes] * len(b)), pa.array([0] * len(b))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_text"), b.column("doc_id"), zero, size, zero, zero],
                                                 names=["doc_id", "_text", "line", "start", "end", "k1", "k2"])
        return run

    monkeypatch.setattr(lines, "_units", told)
    got = [r.end for r in lines.repeated_lines(long_texts).select("end").collect()]
    assert len(got) == 1999 and max(got) < BATCH_BYTES + 100_000


def test_batch_size_of_the_session_stays(spark, long_texts):
    spark.conf.set(BATCH, "1m")
    assert langid.identify(long_texts, None).count() == 2000
    assert spark.conf.get(BATCH) == "1m"


def test_lines(docs, rows, empty):
    first, want = {}, Counter()
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((text or "").split("\n")):
            key = tuple(WORD.findall(line.lower()))
            if len(key) >= 5:
                first.setdefault(key, (doc, n))
    for doc, text, *_ in rows:
        keep = [x for n, x in enumerate((text or "").split("\n"))
                if len(k := tuple(WORD.findall(x.lower()))) < 5 or first[k] == (doc, n)]
        want[doc, None if text is None else "\n".join(keep)] += 1
    got = lines.without_repeats(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        for x in r.removed:
            assert texts[r.doc_id].split("\n")[x.line] == texts[r.doc_id][x.start : x.end]
    assert lines.without_repeats(empty).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.shard_sizes(docs, 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(s, i) for s, n in counts.items() for i in range(n)}
    whole = sharding.sharded(docs, 7)
    assert whole.columns == [*docs.columns, "shard", "slot"] and whole.count() == len(rows)
    assert sharding.shard_sizes(empty, 7).count() == 0


def test_overflow_goes_clockwise_and_moves_little():
    rng = random.Random(2)
    counts = {c: rng.randint(1, 9) for c in rng.sample(range(sharding.CELLS), 3000)}
    own = {}
    for shards in (20, 21):
        out = sharding.flows(counts, shards, 128, 0.1)
        room = sharding.capacities(sum(counts.values()), shards, 0.1)[0]
        loads = Counter()
        for _, a, z, s, _ in out:
            loads[s] += z - a + 1
        assert max(loads.values()) <= room and sum(loads.values()) == sum(counts.values())
        own[shards] = {(c, r): s for c, a, z, s, _ in out for r in range(a, z + 1)}
    moved = sum(own[20][k] != own[21][k] for k in own[20])
    assert moved < 0.25 * len(own[20])


def test_mixing(docs, rows, empty):
    got = mixing.mixture(docs).collect()
    sizes, words = Counter(), Counter()
    for doc, text, _, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        words[doc, n] += 1
    assert Counter((r.doc_id, r.size) for r in got) == words
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-6 and open_:
        total, spare = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                spare += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = spare
    assert {round(r.target, 4) for r in got} == {round(t, 4) for t in target.values()}
    assert all(r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    largest = max(r.size for r in got)
    for t in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == t) - t) <= largest / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs.repartition(3)).collect()))
    assert mixing.mixture(empty).count() == 0
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns


def test_language(spark, docs, empty):
    rng = random.Random(0)
    sound = {"en": ["the", "and", "thing", "with"], "fr": ["le", "que", "été", "eaux"], "de": ["der", "und", "ich", "über"],
             "es": ["el", "ción", "que", "año"], "it": ["gli", "zione", "che", "perché"]}
    known = make(spark, [(i, " ".join(rng.choice(sound[s]) for _ in range(30)), s, "a") for i in range(200) for s in [rng.choice(list(sound))]])
    model = langid.fit(langid.learnable(known))
    held = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert langid.identify(held, model).where("lang_pred <> row.lang").count() == 0
    got = langid.identify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.row.text or ""))) for r in got)
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_toxicity_sample(spark):
    rows = spark.createDataFrame([(i % 40, f"t{i % 40}", 9) for i in range(80)] + [(None, "x", 9)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2 if i else None) for i in range(60)] + [(None, 1)], "doc_id long, label int")
    got = toxicity.sample(rows, labels, 7).collect()
    assert all(r.text == f"t{r.doc_id}" and r.label == r.doc_id % 2 and 0 < r.doc_id < 40 for r in got)
    assert [len({r.doc_id for r in got if r.label == k}) for k in (0, 1)] == [7, 7] and len(got) == 28


def test_toxicity(spark, docs, empty):
    rng = random.Random(0)
    plain, bad = ["table", "river", "morning", "walks", "green", "paper"], ["idiot", "moron", "stupid"]

    def text(toxic, words=bad):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        for _ in range(max(1, len(w) // 20) * toxic):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    known = spark.createDataFrame([(i, text(i % 2), i % 2) for i in range(300)], "doc_id long, text string, label int")
    model = toxicity.fit(known)
    new = make(spark, [(i, text(i % 2, ["idiiot", "morron", "stupidd"]), "en", "a") for i in range(60)])
    got = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    pairs = [got[i] > got[j] for i in got for j in got if i % 2 and not j % 2]
    assert sum(pairs) > 0.9 * len(pairs)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, toxicity.fit(known.where("label = 0"))).count() == 0


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1), (1, None), (104, 0)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    want = Counter()
    for doc, text, *_ in rows:
        w, t = WORD.findall(text or ""), text or ""
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
        want[doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels to admit a cutoff
    assert quality.judged(empty, labels).count() == 0


def test_cutoffs_keep_their_promise():
    assert abs(quality.binomial_at_most(3, 10, 0.5) - 176 / 1024) < 1e-12
    good, bad = np.zeros(200, int), np.zeros(200, int)
    good[10], bad[10], bad[150] = 5000, 100, 400
    assert 10 <= quality.choose_cutoff(good, bad, 0.01, 0.001, 5) < 150
    assert quality.choose_cutoff(good // 100, bad, 0.01, 0.001, 5) == 199


def test_rules_share_one_sequence_at_the_full_risk(spark):
    """400 good texts of a stratum suffice; 200 do not. Symbols catch most bad texts, capitals the others."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    plain = lambda: [word(5) for _ in range(60)]
    texts, labels = [], []
    for lang, n in (("en", 400), ("fr", 200), (None, 400)):
        for i in range(2 * n):
            words, label = plain(), 1 if i < n else None
            if n <= i < n + n // 10:
                label, words = 0, [w + "#" for w in words] if i % 3 else [w.upper() for w in words]
            texts.append((len(texts), " ".join(words), lang, "a"))
            labels.append((texts[-1][0], label))
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    quality_of = dict(labels)
    kept = {r.doc_id: r.kept for r in quality.judged(make(spark, texts).drop("stratum"), table).collect()}
    for i, _, lang, _ in texts:
        assert kept[i] == (quality_of[i] != 0 or lang == "fr")


def test_sequence_of_cutoffs():
    bad, free = np.zeros((2, 200), int), np.zeros((2, 200), int)
    free[:, 5], bad[:, 5] = 100, 1
    bad[0, 150], bad[1, 100], free[1, 100] = 10, 20, 2
    order = quality.sequence(bad, free)
    # each rule goes down bin by bin, the cleaner one first, and neither below its last bad text
    assert order[:150] == [*range(199, 149, -1), *range(399, 299, -1)]
    assert [x for x in order if x < 200] == list(range(199, 4, -1))
    assert [x for x in order if x >= 200] == list(range(399, 204, -1))


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a\\<|end|>"), (1, 1, "user", None), (1, 2, "assistant", "<s>[/INST]\\"), (1, 3, "assistant", "b<"),
             (2, 0, None, ""), (None, 5, "we|ird<|text|>", "x"), (3, None, "assistant", "n"), (3, 1, "assistant", "n"), (3, 1, "assistant", "n")]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, block int")
    chats = chat.format_chats(table)
    got = {r[0]: ([(t.role, t.text) for t in r[1]], r[2]) for r in chats.select(
        "conv_id", chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv in {t[0] for t in turns}:
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        assert got[conv] == (own, "".join(t for r, t in own if r == "assistant"))
    said = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert said[1].n_turns == 4
    assert said[3].turns_sha256 == hashlib.sha256(b"assistant\nn\n" * 3).hexdigest()
    assert chat.format_chats(table.where("false")).count() == 0


def test_a_text_shorter_than_the_item_is_one_window(spark):
    words = [f"w{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = {19: words[:19], 17: words[3:], 16: words[:16], 5: words[:5]}
    table = make(spark, [(n, " " + " ".join(t), "en", "a") for n, t in texts.items()])
    got = {r.doc_id: (round(r.similarity, 9), r.start, r.end) for r in decontamination.matches(table, items).collect()}
    assert got == {n: (round((n - 4) / 16, 9), 1, 1 + len(" ".join(texts[n]))) for n in (19, 17)}
    assert {r.doc_id for r in decontamination.clean(table, items).collect()} == {16, 5}


def test_a_sample_holds_no_repeats(spark):
    rows = [(1, "hot", "en")] * 300 + [(i, f"t{i}", "en") for i in range(2, 30)] + [(1, "hot", "fr"), (None, "n", "fr"), (None, "n", "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n in (5, 29):
        got = Counter(tuple(r) for r in per_class(table, "lang", n).select("doc_id", "text", "lang").collect())
        assert max(got.values()) == 1 and Counter(k[2] for k in got) == {"en": n, "fr": 2}


def test_decontamination(spark, docs, rows, empty):
    words = rows[7][1].split()
    items = spark.createDataFrame(
        [(1, " ".join(words[10:40]), 0), (2, " ".join([*words[40:60], "other", *words[61:70]]), 0), (3, "never seen words in any text here", 0),
         (4, None, 0), (5, "", 0), (6, "éa B", 0)], "item_id long, text string, doc_id long")
    want = {}
    for doc, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(low)
        for item in items.collect():
            own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), item.text or ""))
            size = min(5, len(own))
            if not own:
                continue
            bag = Counter(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
            best = 0
            for s in range(len(w) - len(own) + 1):
                x = w[s : s + len(own)]
                mine = Counter(tuple(x[i : i + size]) for i in range(len(x) - size + 1))
                common = sum((bag & mine).values())
                best = max(best, common / (2 * bag.total() - common))
            if best >= 0.8:
                want[doc, item.item_id] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.matches(docs, items).collect()}
    assert got == want and (7, 1) in got
    assert decontamination.matches(empty, items).count() == 0
    assert decontamination.matches(docs, items.where("false")).count() == 0
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}


@pytest.mark.parametrize("edits, copies", [(5, 120), (10, 60)])
def test_copies_about_the_threshold_lose_no_link_and_few_pairs_are_compared(spark, monkeypatch, edits, copies):
    """Copies whose pairs lie about the threshold, or all below it: classes of all pairs, from pairs in proportion."""
    rng = random.Random(edits)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(copies):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(400)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(copies))
    for i in range(copies):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    compared = []
    plain = neardup.store
    monkeypatch.setattr(neardup, "store", lambda df, name: compared.append(t) or t if (t := plain(df, name)) is not None and name == "checked" else t)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table, 80).collect()}
    assert got == dict(enumerate(root))
    # Copies that are linked are compared in proportion. Where none is linked most pairs share a bucket and have to be looked at.
    pairs = sum(t.count() for t in compared)
    assert (pairs < 25 * copies if edits == 5 else pairs < 1.1 * copies * (copies - 1) / 2) and len(compared) < 6


def test_differences_are_exploded_once(spark):
    rows = [(1, b, 1, b, True, b % 3 == 0, 100, [b // 2, 1000 + b // 4, *range(2000, 2040)]) for b in range(10, 50)]
    schema = "a long, b long, root_a long, root_b long, star boolean, linked boolean, n long, changes array<long>"
    found = neardup._next_buckets(spark.createDataFrame(rows, schema), 80)
    # stored differences are read back: nothing is exploded again on either side of a join
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    met = {}
    for r in found.collect():
        met.setdefault(r.bucket, set()).add(r._node)
    assert {frozenset({2 * i, 2 * i + 1}) for i in range(5, 25)} <= {frozenset(m) for m in met.values()}


@pytest.mark.parametrize("part", [1 << 18, 50])
def test_prefixes_leave_out_differences_that_no_pair_to_be_found_shares(spark, monkeypatch, part):
    """Members with 30 differences of their own and 12 of 40 common ones: every pair that may be linked meets, over few rows."""
    rng, made = random.Random(7), []
    plain = neardup.store
    monkeypatch.setattr(neardup, "store", lambda df, name: made.append(t) or t if (t := plain(df, name)) is not None and name == "prefixes" else t)
    monkeypatch.setattr(neardup, "PART", part, raising=False)
    rows = []
    for a in (1, 2):
        for b in range(10 * a * a, 10 * a * a + 30):
            own = [-1000 * b - i for i in range(rng.choice([4, 30]))]
            rows.append((a, b, 1, 5 if b % 4 == 0 else b, True, b % 4 == 0, 100, [*own, *rng.sample(range(40), 12)]))
    schema = "a long, b long, root_a long, root_b long, star boolean, linked boolean, n long, changes array<long>"
    met = {}
    for r in neardup._next_buckets(spark.createDataFrame(rows, schema), 80).collect():
        met.setdefault(r.bucket, set()).add(r._node)
        assert r._node in {x[1] for x in rows}
    together = {(x, y) for m in met.values() for x in m for y in m}
    wanted = 0
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1] and x[3] != y[3] and not (x[5] and y[5]):
                if 2 * len(set(x[7]) & set(y[7])) >= len(x[7]) + len(y[7]) - 22:  # 22: (100 + 100) * 0.2 / 1.8
                    wanted += 1
                    assert (x[1], y[1]) in together
    assert wanted > 30
    # a difference of one member alone is never sent on
    assert 0 < made[0].count() <= 10 * len(rows), made[0].count()
