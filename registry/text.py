"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.views import EMAILS, emails, table
from threadsieve.functions import text as tx
from threadsieve.functions.lexicons import BOILERPLATE, STOP_WORDS
from threadsieve.operators import fuzzy, lexicon, paragraphs

STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


EDGE_SPACE = rf"^[{tx.SPACE}]+|[{tx.SPACE}]+$"


def q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def sub(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, '{to}', 'g')"


def rewritten(text: str) -> str:
    """The rewriting rules as nested SQL calls, on whole texts."""
    t = f"lower({text})"
    for p in (tx.TAG, tx.CARRIAGE_MARK, tx.ZERO_WIDTH_RUN, tx.DISALLOWED):
        t = sub(t, p)
    words = f"list_filter(regexp_split_to_array({t}, {q(tx.SPACE_RUN)}), lambda w: length(w) BETWEEN 1 AND {tx.MAX_TOKEN})"
    t = f"array_to_string({words}, ' ')"
    for p in (tx.DOT_RUN, tx.ADDRESS, tx.URL, tx.PHONE):
        t = sub(t, p)
    return t


def token_list(text: str, pattern: str = tx.TOKEN) -> str:
    return f"regexp_extract_all({text}, {q(pattern)})"


def no_stops(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: lower(w) NOT IN {STOPS})"


def cleaned(text: str) -> str:
    tokens = token_list(sub(rewritten(f"coalesce({text}, '')"), tx.DIGITS))
    return f"array_to_string({no_stops(tokens)}, ' ')"


def sentence_list(text: str) -> str:
    marked = sub(text, tx.SENTENCE_END, r"\1" + "\u0001")
    trimmed = f"list_transform(string_split({marked}, chr(1)), lambda s: {sub('s', EDGE_SPACE)})"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def docs(spark, d):
    return table(spark, d, "documents", "doc_id")


def chats(spark, d):
    return table(spark, d, "conversations", "conv_id")


@query("rewrite_text", f"SELECT doc_id, {rewritten('text')} AS text FROM documents")
def rewrite_text(spark, d):
    return docs(spark, d).select("doc_id", tx.rewrite(F.col("text")).alias("text"))


@query("clean_text", f"SELECT doc_id, {cleaned('text')} AS preprocessed_email FROM documents")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("preprocessed_email"))


@query("clean_pages", f"SELECT page_id, {cleaned('html')} AS preprocessed_email FROM pages")
def clean_pages(spark, d):
    return table(spark, d, "pages", "page_id").select("page_id", tx.clean(F.col("html")).alias("preprocessed_email"))


_LINE = sub(sub("s", "^>"), EDGE_SPACE)
# Lines of every other turn are quoted, as in a reply.
_QUOTED = "CASE WHEN turn % 2 = 1 THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE text END"


@query("clean_line", f"SELECT conv_id, turn, array_to_string(list_transform(string_split({_QUOTED}, chr(10)), lambda s: {_LINE}), chr(10)) AS text FROM conversations")
def clean_line(spark, d):
    quoted = F.when(
        F.col("turn") % 2 == 1, F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    ).otherwise(F.col("text"))
    return chats(spark, d).select("conv_id", "turn", tx.strip_quote_marks(quoted).alias("text"))


_MARKED = " OR ".join(f"contains(lower(p), '{m}')" for m in tx.HEADER_MARKS)
_PLAIN = sub(sub("text", "_x000D_"), r"\r")


@query("remove_layout", rf"""WITH c AS (SELECT doc_id, array_to_string(list_transform(string_split({_PLAIN}, chr(10)), lambda s: {_LINE}), chr(10)) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda p: NOT ({_MARKED} OR regexp_matches(lower(p), {q(tx.PHONE)})
OR regexp_matches(lower(p), {q(tx.ADDRESS)})) AND len(regexp_extract_all(p, {q(tx.NON_SPACE)})) >= 10), chr(10)) AS text FROM c""")
def remove_layout(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_layout(F.col("text"), "\n").alias("text"))


@query("dedup_paragraphs", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, p, min(i) AS i FROM p GROUP BY doc_id, p)
SELECT doc_id, string_agg(p, chr(10) ORDER BY i) AS text FROM f GROUP BY doc_id""")
def dedup_paragraphs(spark, d):
    return docs(spark, d).select("doc_id", tx.dedup_paragraphs(F.col("text"), "\n").alias("text"))


_LINES = "string_split(" + sub("text", r"\n+", "' || chr(10) || '") + ", chr(10))"


@query("remove_short_lines", f"""SELECT doc_id, array_to_string(list_filter({_LINES}, lambda s: len(regexp_extract_all(s, {q(tx.NON_SPACE)})) >= 10), chr(10)) AS text FROM documents""")
def remove_short_lines(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_short_lines(F.col("text")).alias("text"))


_HIT = " OR ".join(f"contains(lower(s), '{p}')" for p in BOILERPLATE)


@query("remove_phrases", f"SELECT doc_id, array_to_string(list_filter({sentence_list('text')}, lambda s: NOT ({_HIT})), ' ') AS text FROM documents")
def remove_phrases(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_phrases(F.col("text")).alias("text"))


_RX = [r"licen[sc]ed under", r"all rights reserved\.?", r"copyright (\(c\) )?[0-9]{4}"]
_RX_HIT = " OR ".join(f"regexp_matches(s, '(?i){p}')" for p in _RX)


@query("remove_phrases_regex", f"SELECT doc_id, array_to_string(list_filter({sentence_list('text')}, lambda s: NOT ({_RX_HIT})), ' ') AS text FROM documents")
def remove_phrases_regex(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_phrases(F.col("text"), _RX, regex=True).alias("text"))


PHRASES = f"phrases AS (SELECT DISTINCT lower(unnest({sentence_list('text')})) AS phrase FROM benchmark)"


def phrase_table(spark, d):
    sentences = tx.split_sentences(F.col("text"))
    return table(spark, d, "benchmark").select(F.explode(sentences).alias("phrase"))


@query("remove_phrase_table", f"""WITH {PHRASES}, s AS (SELECT doc_id, unnest({sentence_list('text')}) AS s, generate_subscripts({sentence_list('text')}, 1) AS i FROM documents),
hit AS (SELECT DISTINCT s.doc_id, s.i FROM s JOIN phrases ON contains(lower(s.s), phrase)),
kept AS (SELECT s.* FROM s ANTI JOIN hit ON s.doc_id = hit.doc_id AND s.i = hit.i)
SELECT d.doc_id, coalesce(string_agg(k.s, ' ' ORDER BY k.i), '') AS text FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id""")
def remove_phrase_table(spark, d):
    found = lexicon.remove_phrase_table(docs(spark, d), phrase_table(spark, d), "text", "doc_id")
    return found.select("doc_id", "text")


@query("remove_phrases_fuzzy")
def remove_phrases_fuzzy(spark, d):
    return fuzzy.remove_similar_phrases(docs(spark, d), BOILERPLATE, "text").select("doc_id", "text")


@query("near_dup_paragraphs", rf"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(p), '[{tx.WORD}]+')) AS term FROM p),
v AS (SELECT doc_id, i, term, count(*) AS n FROM t GROUP BY ALL),
nn AS (SELECT doc_id, i, sum(n * n)::DOUBLE AS norm FROM v GROUP BY ALL),
dots AS (SELECT a.doc_id, a.i, b.i AS j, sum(a.n * b.n)::DOUBLE AS dot FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.i < b.i GROUP BY ALL),
gone AS (SELECT DISTINCT x.doc_id, x.i FROM dots x JOIN nn a ON a.doc_id = x.doc_id AND a.i = x.i JOIN nn b ON b.doc_id = x.doc_id AND b.i = x.j
  WHERE x.dot * x.dot > (0.98::DOUBLE * 0.98::DOUBLE) * a.norm * b.norm)
SELECT d.doc_id, coalesce(string_agg(k.p, chr(10) ORDER BY k.i), '') AS text FROM documents d
LEFT JOIN (SELECT * FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i) k ON d.doc_id = k.doc_id GROUP BY d.doc_id""")
def near_dup_paragraphs(spark, d):
    return paragraphs.drop_similar_paragraphs(docs(spark, d), "text", "\n").select("doc_id", "text")


@query("near_dup_vectors", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
gone AS (SELECT DISTINCT a.vec_id FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_dot_product(a.e, b.e) > 0 AND list_dot_product(a.e, b.e) ** 2 > 0.98::DOUBLE * 0.98::DOUBLE * list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM gone)""")
def near_dup_vectors(spark, d):
    vectors = table(spark, d, "embeddings")
    return paragraphs.drop_similar_vectors(vectors, "label", "vec_id", "embedding").select("vec_id", "label")


@query("split_sentences", f"SELECT conv_id, turn, array_to_string({sentence_list('text')}, '|') AS sentences, CAST(len({sentence_list('text')}) AS INTEGER) AS n FROM conversations")
def split_sentences(spark, d):
    s = tx.split_sentences(F.col("text"))
    return chats(spark, d).select("conv_id", "turn", F.array_join(s, "|").alias("sentences"), F.size(s).alias("n"))


@query("tokenize_words", f"SELECT doc_id, array_to_string({token_list('text')}, ' ') AS tokens FROM documents")
def tokenize_words(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


@query("tokenize_wordpunct", f"SELECT doc_id, array_to_string({token_list('text', tx.WORD_OR_PUNCT)}, ' ') AS tokens FROM documents")
def tokenize_wordpunct(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(tx.tokenize_word_punct(F.col("text")), " ").alias("tokens"))


@query("remove_stopwords", f"SELECT doc_id, array_to_string({no_stops(token_list('text'))}, ' ') AS tokens FROM documents")
def remove_stopwords(spark, d):
    kept = tx.without_stop_words(tx.tokenize(F.col("text")))
    return docs(spark, d).select("doc_id", F.array_join(kept, " ").alias("tokens"))


def bow(text: str) -> str:
    kept = f"array_to_string({no_stops(token_list(text))}, ' ')"
    letters = f"replace({sub(kept, f'([0-9]|[^{tx.WORD}]|' + chr(92) + 'p{Nd})+', ' ')}, '_', '')"
    return f"array_to_string(regexp_extract_all({letters}, {q(tx.NON_SPACE)}), ' ')"


@query("bow_normalize", f"SELECT doc_id, {bow('text')} AS bag_of_word FROM documents")
def bow_normalize(spark, d):
    return docs(spark, d).select("doc_id", tx.bag_of_words(F.col("text")).alias("bag_of_word"))


DICTIONARY = rf"dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{tx.WORD}]+')) AS word FROM benchmark)"


def dictionary(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"[{tx.WORD}]+"), 0)
    return table(spark, d, "benchmark").select(F.explode(words).alias("word")).distinct()


@query("bow_dictionary", f"""WITH {DICTIONARY}, b AS (SELECT doc_id, {bow('text')} AS t FROM documents),
w AS (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM b),
k AS (SELECT w.* FROM w SEMI JOIN dict ON lower(w.w) = dict.word)
SELECT d.doc_id, coalesce(string_agg(k.w, ' ' ORDER BY k.i), '') AS bag_of_word FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""")
def bow_dictionary(spark, d):
    bags = docs(spark, d).select("doc_id", tx.bag_of_words(F.col("text")).alias("bag_of_word"))
    return lexicon.keep_dictionary_words(bags, "bag_of_word", dictionary(spark, d), "doc_id")


@query("text_length", f"SELECT doc_id, CAST(len(regexp_extract_all(text, {q(tx.NON_SPACE)})) AS INTEGER) AS text_length FROM documents")
def text_length(spark, d):
    return docs(spark, d).select("doc_id", tx.word_count(F.col("text")).alias("text_length"))


# Complaints against the rest, words of the dictionary table as the lexicon.
CLASS_WORDS = rf"""{EMAILS}, {DICTIONARY}, w AS (SELECT DISTINCT snapshot_id, CASE WHEN is_complaint = 'Y' OR is_feedback = 'Y' THEN 1 ELSE 0 END AS target,
  unnest(regexp_extract_all(lower(email), '{tx.TERM}')) AS word FROM emails),
c AS (SELECT target, word, count(*) AS doc_count FROM w SEMI JOIN dict ON w.word = dict.word GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY doc_count DESC, word) AS INTEGER) AS place FROM c QUALIFY place <= 50),
chosen AS (SELECT word FROM top WHERE target = 1 EXCEPT SELECT word FROM top WHERE target = 0)"""


def _words(spark, d):
    from threadsieve.operators.rows import complaint
    return emails(spark, d, heavy=True).select(
        "snapshot_id", complaint(True).alias("target"), tx.terms(F.col("email")).alias("words")
    )


def _top(spark, d):
    counts = lexicon.word_df_by_class(_words(spark, d), "words", lexicon=dictionary(spark, d))
    return lexicon.top_words(counts, 50)


@query("word_df_by_class", f"WITH {CLASS_WORDS} SELECT target, word, doc_count FROM c")
def word_df_by_class(spark, d):
    return lexicon.word_df_by_class(_words(spark, d), "words", lexicon=dictionary(spark, d))


@query("topk_words", f"WITH {CLASS_WORDS} SELECT target, word, doc_count, place FROM top")
def topk_words(spark, d):
    return _top(spark, d)


@query("discriminative_words", f"WITH {CLASS_WORDS} SELECT word FROM chosen")
def discriminative_words(spark, d):
    return lexicon.discriminative_words(_top(spark, d))


@query("join_lexicon_semi", rf"""WITH {DICTIONARY}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.TERM}')) AS word FROM documents)
SELECT word, count(*) AS n FROM w SEMI JOIN dict ON w.word = dict.word GROUP BY word""")
def join_lexicon_semi(spark, d):
    words = docs(spark, d).select("doc_id", F.explode(tx.terms(F.col("text"))).alias("word"))
    return lexicon.words_in(words, dictionary(spark, d)).groupBy("word").agg(F.count("*").alias("n"))


@query("lexicon_flag", f"""WITH {CLASS_WORDS} SELECT snapshot_id, CASE WHEN len(list_intersect(regexp_extract_all(lower(email), '{tx.TERM}'),
  (SELECT list(word) FROM chosen))) > 0 THEN 1 ELSE 0 END AS negative_word FROM emails""")
def lexicon_flag(spark, d):
    chosen = lexicon.discriminative_words(_top(spark, d))
    return lexicon.flag_words(_words(spark, d), "words", chosen).select("snapshot_id", "negative_word")
