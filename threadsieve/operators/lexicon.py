"""Word-set operators: lexicon hits, discriminative words, phrase tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.functions.text import NON_SPACE, WORD, drop_sentences, split_sentences
from threadsieve.session import hint_if_small, store

# Phrases without any word up to this number are searched in every text.
SEARCHED = 1000


def words_in(words: DataFrame, lexicon: DataFrame, column: str = "word", listed: bool = True) -> DataFrame:
    """Rows whose word is in the lexicon.

    A ``listed`` lexicon is a stored list: its size is checked and decides on a
    broadcast. A derived one is not computed just to be counted; the join is
    left to the optimizer.
    """
    side = lexicon.select(column)
    return words.join(hint_if_small(side) if listed else side, column, "left_semi")


def words_not_in(words: DataFrame, lexicon: DataFrame, column: str = "word", listed: bool = True) -> DataFrame:
    """Rows whose word is not in the lexicon."""
    side = lexicon.select(column)
    return words.join(hint_if_small(side) if listed else side, column, "left_anti")


def word_df_by_class(
    df: DataFrame, words: str, target: str = "target", lexicon: DataFrame | None = None
) -> DataFrame:
    """Documents per (class, word); a document counts a word once."""
    exploded = df.select(target, F.explode(F.array_distinct(words)).alias("word"))
    if lexicon is not None:
        exploded = words_in(exploded, lexicon)
    return exploded.groupBy(target, "word").agg(F.count("*").alias("doc_count"))


def top_words(counts: DataFrame, n: int = 50, target: str = "target") -> DataFrame:
    """The ``n`` most frequent words of each class, ties by word."""
    w = Window.partitionBy(target).orderBy(F.col("doc_count").desc(), "word")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def discriminative_words(top: DataFrame, target: str = "target") -> DataFrame:
    """Words on the top list of class 1 and not on that of class 0.

    ``top`` comes from ``top_words``, so the other list has at most n words.
    """
    mine = top.where(F.col(target) == 1).select("word")
    other = top.where(F.col(target) == 0).select("word")
    return mine.join(F.broadcast(other), "word", "left_anti")


def flag_words(df: DataFrame, words: str, found: DataFrame, name: str = "negative_word") -> DataFrame:
    """1 where any word is in ``found``, a set bounded by its top-n parameter."""
    chosen = found.agg(F.collect_set("word").alias("w")).select("w").scalar()
    hit = F.arrays_overlap(F.col(words), chosen)
    return df.withColumn(name, F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0))


def keep_dictionary_words(
    df: DataFrame, text: str, dictionary: DataFrame, row_id: str = "snapshot_id", name: str | None = None
) -> DataFrame:
    """Keep the words of a text that a dictionary table has, in order.

    Distinct words are looked up; each text is then filtered in its own row by
    the set of its words that were found.
    """
    words = F.regexp_extract_all(text, F.lit(NON_SPACE), 0)
    known = dictionary.select(F.lower("word").alias("word"))
    found = (
        words_in(
            df.select(row_id, F.explode(F.array_distinct(F.transform(words, F.lower))).alias("word")), known
        )
        .groupBy(F.col(row_id).alias("_row")).agg(F.collect_set("word").alias("_known"))
    )
    kept = F.filter(words, lambda w: F.coalesce(F.array_contains("_known", F.lower(w)), F.lit(False)))
    joined = df.join(found, F.col(row_id).eqNullSafe(F.col("_row")), "left")
    return joined.withColumn(name or text, F.array_join(kept, " ")).drop("_known", "_row")


def remove_phrase_table(
    df: DataFrame, phrases: DataFrame, text: str = "email", row_id: str = "snapshot_id", name: str | None = None
) -> DataFrame:
    """Drop the sentences holding any phrase of a table of any size.

    A phrase inside a text brings each of its inner words along as a whole
    word, so texts meet phrases by an equi join on one of them: of the two
    longest the one that fewer texts have. The texts' words are read once, only
    those that phrases name are kept, and their counts choose the anchors.
    A phrase of one or two words has no inner word: its longest word lies within
    some word of the text, at its start or end or as the whole where the phrase goes on
    beside it, found among the distinct words of all texts by their character trigrams. Phrases without any word, if there are a few, are searched in each text.
    A kind of phrase that the table does not hold costs nothing, and a text
    that meets no phrase gives no row.
    The phrases met by a text are then searched in its sentences, in its own row.
    Rows with a null id meet phrases like any other.
    """
    low = F.lower("phrase")
    every = F.regexp_extract_all(low, F.lit(rf"[{WORD}]+"), 0)
    inner = F.slice(every, F.lit(2), F.greatest(F.size(every) - 2, F.lit(0)))
    listed = store(phrases.select(low.alias("phrase")).where(F.length("phrase") > 0).distinct().select(
        "phrase", _longest(inner, 2).alias("words"), F.get(_longest(every, 1), F.lit(0)).alias("part")), "phrases")
    kinds = listed.agg(
        F.count_if(F.size("words") > 0), F.count_if((F.size("words") == 0) & F.col("part").isNotNull()), F.count_if(F.col("part").isNull())).first()
    # where the phrase goes on beside its longest word, with a blank or a mark, the word of the text ends there too
    said = F.regexp_extract_all("phrase", F.lit(rf"[{WORD}]+"), F.lit(0))
    begins = (F.get(said, F.lit(0)) != F.col("part")) | ~F.startswith("phrase", "part")
    ends = (F.element_at(said, -1) != F.col("part")) | ~F.endswith("phrase", "part")
    partial = listed.where((F.size("words") == 0) & F.col("part").isNotNull()).select(
        "phrase", "part", begins.alias("begins"), ends.alias("ends"))

    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]+"), 0))
    texts = df.select(F.col(row_id).alias("_row"), F.explode(words).alias("word"))
    met = []
    if kinds[0]:
        named = listed.select("phrase", F.explode("words").alias("word"))
        held = store(texts.join(hint_if_small(named.select("word").distinct()), "word"), "held")
        often = held.groupBy("word").agg(F.count("*").alias("texts"))
        # words that no text has anchor no phrase that any text could hold
        rarest = named.join(often, "word", "left").groupBy("phrase").agg(
            F.min_by("word", F.struct(F.coalesce("texts", F.lit(0)), "word")).alias("word"))
        met.append(held.join(hint_if_small(rarest), "word").select("_row", "phrase"))
    if kinds[1]:
        parts = partial.withColumn("gram", F.col("part").substr(1, 3))
        vocabulary = texts.select("word").distinct()
        within = store(
            vocabulary.select("word", F.explode(_grams(F.col("word"))).alias("gram"))
            .join(hint_if_small(parts), "gram").where(F.contains("word", "part"))
            .where(~F.col("begins") | F.startswith("word", "part")).where(~F.col("ends") | F.endswith("word", "part"))
            .select("phrase", "word").distinct(), "within")
        met.append(texts.join(hint_if_small(within), "word").select("_row", "phrase"))
    if kinds[2] > SEARCHED:
        # Blanks cannot anchor, since sentences are split at them: a phrase of blanks alone is met by every text.
        marks = listed.where("part IS NULL").select(
            "phrase", F.coalesce(F.regexp_substr("phrase", F.lit(NON_SPACE)), F.lit("")).substr(1, 1).alias("word"))
        signs = F.array_distinct(F.split(F.regexp_replace(F.lower(text), rf"[{WORD}]+", ""), ""))
        others = df.select(F.col(row_id).alias("_row"), F.explode(F.array_union(signs, F.array(F.lit("")))).alias("word"))
        met.append(others.join(hint_if_small(marks), "word").select("_row", "phrase"))

    none = F.array().cast("array<string>")
    searched = none
    if 0 < kinds[2] <= SEARCHED:
        searched = F.coalesce(listed.where("part IS NULL").agg(F.collect_list("phrase")).scalar(), none)
    found = df.withColumn("_searched", searched)
    if met:
        both = reduce(DataFrame.unionByName, met).groupBy("_row").agg(F.collect_set("phrase").alias("_met"))
        found = found.join(both, F.col(row_id).eqNullSafe(F.col("_row")), "left").withColumn(
            "_searched", F.concat("_searched", F.coalesce("_met", none))).drop("_met", "_row")

    def hit(_, low_sentence):
        return F.exists("_searched", lambda p: F.contains(low_sentence, p))

    return found.withColumn(name or text, F.when(F.size("_searched") > 0, drop_sentences(F.col(text), hit)).otherwise(
        F.array_join(split_sentences(F.col(text)), " "))).drop("_searched")


def _longest(words, n):
    """The ``n`` longest distinct words, ties by word."""
    ordered = F.sort_array(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(F.slice(ordered, 1, n), lambda x: x["w"])


def _grams(word):
    """All substrings of one to three characters: the start of any part of the word is among them."""
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.array(*[F.substring(word, i, F.lit(n)) for n in (1, 2, 3)]))))
