"""N-grams, vocabulary, TF-IDF, packing and masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.ml.feature import StringIndexer

from registry import query
from registry.text import STOPS, chats, docs, q, token_list
from registry.views import EMAILS, TARGET, emails, r9, table
from threadsieve.functions import text as tx
from threadsieve.functions.lexicons import STOP_WORDS
from threadsieve.operators import packing, tfidf

MAX_FEATURES = 7000


def _grams(stops: bool = False, cols: str = "doc_id", source: str = "documents", text: str = "text") -> str:
    """Terms with positions, then 1- and 2-grams, as SQL tables."""
    tokens = token_list(f"lower({text})", tx.TERM)
    if stops:
        tokens = f"list_filter({tokens}, lambda w: w NOT IN {STOPS})"
    return f"""tok AS (SELECT {cols}, unnest({tokens}) AS w, generate_subscripts({tokens}, 1) AS i FROM {source}),
grams AS (SELECT {cols}, w AS term FROM tok UNION ALL
  SELECT a.{cols}, a.w || ' ' || b.w FROM tok a JOIN tok b ON a.{cols} = b.{cols} AND b.i = a.i + 1),
tc AS (SELECT {cols}, term, count(*) AS n FROM grams GROUP BY ALL)"""


def _vocab(max_features: int = MAX_FEATURES) -> str:
    return f"""nd AS (SELECT count(*) AS total FROM documents),
vocab AS (SELECT term, tf, df, ln((1 + total) / (1 + df)) + 1 AS idf FROM (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM tc GROUP BY term), nd
  WHERE df >= 2 AND df <= 0.9::DOUBLE * total ORDER BY tf DESC, term LIMIT {max_features})"""


TFIDF = f"""{_grams()}, {_vocab()},
raw AS (SELECT tc.doc_id, tc.term, tc.n * v.idf AS w FROM tc JOIN vocab v USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id),
tfidf AS (SELECT r.doc_id, r.term, r.w / n.norm AS tfidf FROM raw r JOIN norms n USING (doc_id))"""


@query("ngrams", f"WITH {_grams()} SELECT doc_id, term, CAST(n AS INTEGER) AS n FROM tc")
def ngrams(spark, d):
    return tfidf.term_counts(docs(spark, d), "text", "doc_id")


@query("tfidf_vocab", f"WITH {_grams()}, {_vocab()} SELECT term, tf, df FROM vocab")
def tfidf_vocab(spark, d):
    return tfidf.vocabulary(docs(spark, d), "text", row_id="doc_id", max_features=MAX_FEATURES).select("term", "tf", "df")


@query("tfidf_vocab_stop_words", f"WITH {_grams(stops=True)}, {_vocab(1000)} SELECT term, tf, df FROM vocab")
def tfidf_vocab_stop_words(spark, d):
    return tfidf.vocabulary(
        docs(spark, d), "text", row_id="doc_id", max_features=1000, stop_words=STOP_WORDS
    ).select("term", "tf", "df")


@query("tfidf_idf", f"WITH {_grams()}, {_vocab()} SELECT term, round(idf, 9) AS idf FROM vocab")
def tfidf_idf(spark, d):
    return tfidf.vocabulary(docs(spark, d), "text", row_id="doc_id", max_features=MAX_FEATURES).select("term", r9("idf"))


def _vectors(spark, d):
    texts = docs(spark, d)
    model = tfidf.fit_vectors(texts, "text", max_features=MAX_FEATURES, row_id="doc_id")
    return model, tfidf.vectorize(model, texts)


@query("tfidf_long", f"WITH {TFIDF} SELECT doc_id, term, round(tfidf, 9) AS tfidf FROM tfidf")
def tfidf_long(spark, d):
    model, vectors = _vectors(spark, d)
    long = tfidf.explode_vectors(vectors, tfidf.vocabulary_of(model), row_id="doc_id")
    return long.select("doc_id", "term", r9("tfidf"))


@query("tfidf_join", f"WITH {TFIDF} SELECT doc_id, term, round(tfidf, 9) AS tfidf FROM tfidf")
def tfidf_join(spark, d):
    texts = docs(spark, d)
    vocab = tfidf.vocabulary(texts, "text", row_id="doc_id", max_features=MAX_FEATURES)
    long = tfidf.weigh(tfidf.term_counts(texts, "text", "doc_id"), vocab, "doc_id")
    return long.select("doc_id", "term", r9("tfidf"))


@query("flt_zero_features", f"WITH {TFIDF} SELECT DISTINCT doc_id FROM tfidf")
def flt_zero_features(spark, d):
    return tfidf.has_features(_vectors(spark, d)[1]).select("doc_id")


@query("feature_table", f"""WITH {EMAILS}, {TFIDF}, hits AS (SELECT doc_id, count(*) AS n FROM tfidf GROUP BY doc_id)
SELECT snapshot_id, gcid, {TARGET} AS target_variable, CAST((SELECT count(*) FROM vocab) + 1 AS INTEGER) AS n_features,
CAST(coalesce(n, 0) + CASE WHEN len(regexp_extract_all(email, {q(tx.NON_SPACE)})) > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_set
FROM emails LEFT JOIN hits ON doc_id = snapshot_id""")
def feature_table(spark, d):
    from threadsieve.operators.rows import complaint
    messages = emails(spark, d, heavy=True).select(
        "snapshot_id", "gcid", "thread_id", F.col("time").alias("time_variable"), complaint().alias("target"),
        F.coalesce("email", F.lit("")).alias("preprocessed_email"), tx.word_count(F.col("email")).alias("text_length"),
    )
    model = tfidf.fit_vectors(messages, max_features=MAX_FEATURES)
    table_ = tfidf.feature_table(
        tfidf.vectorize(model, messages), ["snapshot_id", "gcid", "thread_id", "time_variable"], extra=["text_length"]
    )
    parts = F.unwrap_udt("features")
    return table_.select(
        "snapshot_id", "gcid", "target_variable", F.coalesce(parts["size"].cast("int"), F.size(parts["values"])).alias("n_features"),
        F.size(F.filter(parts["values"], lambda v: v != 0)).alias("n_set"),
    )


@query("label_encode", """SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code FROM events""")
def label_encode(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    indexer = StringIndexer(inputCol="event_type", outputCol="code", stringOrderType="alphabetAsc")
    return indexer.fit(events).transform(events)


def _token_counter():
    """Tokens of a small subword rule: pieces of at most four characters."""
    return lambda texts: [sum(-(-len(w) // 4) for w in t.split()) for t in texts]


@query("token_length", f"""SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), {q(tx.NON_SPACE)}),
lambda w: (length(w) + 3) // 4)), 0) AS INTEGER) AS text_length FROM documents""")
def token_length(spark, d):
    from threadsieve.functions.tokens import token_length as length
    return docs(spark, d).select("doc_id", length(F.col("text"), _token_counter).alias("text_length"))


BATCH, CHUNK = 100, 128


@query("pack_chunks", f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {token_list('text')} AS tokens FROM conversations),
p AS (SELECT id, tokens, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) - 1 AS pos FROM t),
u AS (SELECT pos // {BATCH} AS batch, pos, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM p),
o AS (SELECT batch, tok, row_number() OVER (PARTITION BY batch ORDER BY pos, i) - 1 AS place FROM u)
SELECT batch, place // {CHUNK} AS chunk, string_agg(tok, ' ' ORDER BY place) AS tokens FROM o GROUP BY ALL HAVING count(*) = {CHUNK}""")
def pack_chunks(spark, d):
    lists = chats(spark, d).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.tokenize(F.col("text")).alias("tokens")
    )
    batched = packing.batches(lists, BATCH, "id")
    packed = packing.pack(batched, "tokens", "batch", "place", CHUNK)
    return packed.select("batch", "chunk", F.array_join("tokens", " ").alias("tokens"))


_WORDS = token_list("text", rf"[{tx.WORD}]+|[^{tx.WORD}{tx.SPACE}]")


@query("mask_words", f"""WITH w AS (SELECT conv_id, turn, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS wid FROM conversations),
p AS (SELECT conv_id, turn, wid, unnest(regexp_extract_all(word, '.{{1,4}}')) AS piece, generate_subscripts(regexp_extract_all(word, '.{{1,4}}'), 1) AS k FROM w),
m AS (SELECT *, substr(md5('101:' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || ':' || CAST(wid AS VARCHAR)), 1, 8) < '26666666'
  AND piece NOT IN ('.', '..') AS hit FROM p)
SELECT c.conv_id, c.turn, coalesce(string_agg(CASE WHEN hit THEN '[MASK]' ELSE piece END, ' ' ORDER BY wid, k), '') AS tokens,
  coalesce(string_agg(CASE WHEN hit THEN piece ELSE '-100' END, ' ' ORDER BY wid, k), '') AS labels
FROM conversations c LEFT JOIN m ON c.conv_id = m.conv_id AND c.turn = m.turn GROUP BY c.conv_id, c.turn""")
def mask_words(spark, d):
    words = F.regexp_extract_all("text", F.lit(rf"[{tx.WORD}]+|[^{tx.WORD}{tx.SPACE}]"), 0)
    split = F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(".{1,4}"), 0))
    ids = F.flatten(F.transform(split, lambda ps, i: F.transform(ps, lambda p: i)))
    masked = tx.mask_words(
        F.col("pieces"), F.col("ids"), F.concat_ws("-", "conv_id", "turn"), 0.15, 101, special=[".", ".."]
    )
    return (
        chats(spark, d).select("conv_id", "turn", F.flatten(split).alias("pieces"), ids.alias("ids"))
        .withColumn("m", masked)
        .select(
            "conv_id", "turn", F.array_join("m.tokens", " ").alias("tokens"),
            F.array_join("m.labels", " ", "-100").alias("labels"),
        )
    )


# Pieces of words of four characters, with ids that begin anew in each list, packed and then masked word by word.
@query("pack_then_mask", f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS wid FROM conversations),
p AS (SELECT id, wid, unnest(regexp_extract_all(word, '.{{1,4}}')) AS piece, generate_subscripts(regexp_extract_all(word, '.{{1,4}}'), 1) AS k FROM w),
l AS (SELECT conv_id * 1000 + turn AS id, row_number() OVER (ORDER BY md5(CAST(conv_id * 1000 + turn AS VARCHAR))) - 1 AS pos FROM conversations),
o AS (SELECT pos // {BATCH} AS batch, piece, wid, row_number() OVER (PARTITION BY pos // {BATCH} ORDER BY pos, wid, k) - 1 AS place FROM p JOIN l USING (id)),
c AS (SELECT batch, place // {CHUNK} AS chunk, place, piece, wid, wid IS DISTINCT FROM lag(wid) OVER (PARTITION BY batch, place // {CHUNK} ORDER BY place) AS opens FROM o),
n AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY batch, chunk ORDER BY place) - 1 AS word FROM c),
m AS (SELECT *, substr(md5('101:' || CAST(batch AS VARCHAR) || '-' || CAST(chunk AS VARCHAR) || ':' || CAST(word AS VARCHAR)), 1, 8) < '26666666'
  AND piece NOT IN ('.', '..') AS hit FROM n)
SELECT batch, chunk, string_agg(CASE WHEN hit THEN '[MASK]' ELSE piece END, ' ' ORDER BY place) AS tokens,
  string_agg(CASE WHEN hit THEN piece ELSE '-100' END, ' ' ORDER BY place) AS labels, count(*) AS attended
FROM m GROUP BY batch, chunk HAVING count(*) = {CHUNK}""")
def pack_then_mask(spark, d):
    words = F.regexp_extract_all("text", F.lit(rf"[{tx.WORD}]+|[^{tx.WORD}{tx.SPACE}]"), 0)
    split = F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(".{1,4}"), 0))
    lists = chats(spark, d).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.flatten(split).alias("pieces"),
        F.flatten(F.transform(split, lambda ps, i: F.transform(ps, lambda p: i))).alias("word_ids"))
    lists = lists.withColumn("attention", F.transform("pieces", lambda p: F.lit(1)))
    packed = packing.pack(packing.batches(lists, BATCH, "id"), ["pieces", "attention", "word_ids"], "batch", "place", CHUNK)
    masked = packing.mask_chunks(packed, "pieces", "word_ids", ["batch", "chunk"], special=[".", ".."])
    return masked.select(
        "batch", "chunk", F.array_join("pieces", " ").alias("tokens"), F.array_join("labels", " ", "-100").alias("labels"),
        F.aggregate("attention", F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"))
