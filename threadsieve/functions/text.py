"""Text rewriting, tokenising and length as native column expressions.

Patterns spell out white space, letters and digits as Unicode classes, so they
mean the same in every regular-expression engine, and use no look-around.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadsieve.functions.lexicons import BOILERPLATE, STOP_WORDS

# Members of a character class: Unicode white space, and word characters.
# Control characters are listed one by one: they then share one bit set in Java.
SPACE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"

# The cleaning rules and the header marks of quoted messages.
TAG = r"<[^>]*>"
CARRIAGE_MARK = "_x000d_"
ZERO_WIDTH_RUN = r"\x{200C}\x{A0}+"
DISALLOWED = rf"[^A-Za-z{SPACE}\p{{Nd}}+/.:\-,;?'\"%$]"
MAX_TOKEN = 20
DOT_RUN = r"( \.){2,}"
ADDRESS = rf"\p{{Nd}}+[{SPACE}]+[a-zA-Z0-9{SPACE},]+[{SPACE}]+[a-zA-Z]+[{SPACE}]+\p{{Nd}}{{5}}"
URL = (
    r"(?:https?:\/\/)?(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"(?:[-a-zA-Z0-9()@:%_\+.~#?&\/=]*)"
)
PHONE = rf"\(?\p{{Nd}}{{3}}\)?[.\-{SPACE}]?\p{{Nd}}{{3}}[.\-{SPACE}]?\p{{Nd}}{{4}}"
HEADER_MARKS = [
    "from:", "date:", "sent:", "to:", "cc:", "subject:", "importance:", "reply-to:", "mailto:",
]
MIN_WORDS = 10

# The rules as they are run. A failing match attempt is repeated from every later
# start, which is quadratic on long texts; so the second alternative takes the
# stretch in which no later start can succeed either, and $1 puts it back.
TAG_OR_OPEN = r"<[^>]*>|(<[^>]*\z)"
ADDRESS_OR_RUN = (
    r"\p{Nd}+ [a-zA-Z0-9 ,]+ [a-zA-Z]+ \p{Nd}{5}|(\p{Nd}+ (?:[a-zA-Z0-9 ,]*[a-zA-Z ,])?)"
)
ADDRESS_FOUND = (
    rf"(\p{{Nd}}[{SPACE}][a-zA-Z0-9{SPACE},]+[{SPACE}][a-zA-Z]+[{SPACE}]+\p{{Nd}}{{5}})"
    rf"|\p{{Nd}}[{SPACE}][a-zA-Z0-9{SPACE},]*"
)
LONG_TOKEN = rf" ?[^ ]{{{MAX_TOKEN + 1},}}"
SPACE_RUN = rf"[{SPACE}]+"
NON_SPACE = rf"[^{SPACE}]+"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
DIGITS = r"\p{Nd}+"
TOKEN = rf"[{WORD}]+(?:'[{WORD}]+)?|[^{WORD}{SPACE}]"
WORD_OR_PUNCT = rf"[{WORD}]+|[^{WORD}{SPACE}]+"
TERM = rf"[{WORD}]{{2,}}"
SENTENCE_END = rf"([.!?])[{SPACE}]+"
NUMERIC = r"^\p{N}+$"
NON_LETTERS = r"[^\p{L}\p{Nl}\p{No}_]+"


def _delete(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def normalise_quotes(text: Column) -> Column:
    """Backtick and right single quotation mark become an apostrophe."""
    return F.translate(text, "`’", "''")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_SPACE))


def tokenize(text: Column) -> Column:
    """Words (with an inner apostrophe) and single punctuation marks, in order."""
    return _all(text, TOKEN)


def tokenize_word_punct(text: Column) -> Column:
    """Runs of word characters or runs of punctuation."""
    return _all(text, WORD_OR_PUNCT)


def split_sentences(text: Column) -> Column:
    marked = F.regexp_replace(text, SENTENCE_END, "$1\u0001")
    trimmed = F.transform(F.split(marked, "\u0001"), _strip)
    return F.filter(trimmed, lambda s: s != "")


def without_stop_words(tokens: Column, stop_words: list[str] | None = STOP_WORDS) -> Column:
    """Drop stop words whatever their case, keeping order and repeats."""
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda w: ~F.lower(w).isin(stop_words))


def rewrite(text: Column) -> Column:
    """The ordered rewriting rules, up to the removal of phone numbers."""
    t = F.lower(text)
    t = F.regexp_replace(t, TAG_OR_OPEN, "$1")
    t = _delete(t, CARRIAGE_MARK)
    t = _delete(t, ZERO_WIDTH_RUN)
    t = _delete(t, DISALLOWED)
    t = F.trim(_delete(F.regexp_replace(t, SPACE_RUN, " "), LONG_TOKEN))
    t = F.regexp_replace(_delete(t, DOT_RUN), ADDRESS_OR_RUN, "$1")
    # A URL match never crosses a space, so only tokens with a dot are tried.
    t = F.array_join(
        F.transform(F.split(t, " "), lambda w: F.when(w.contains("."), _delete(w, URL)).otherwise(w)), " "
    )
    return _delete(t, PHONE)


def clean_tokens(text: Column, stop_words: list[str] | None = STOP_WORDS) -> Column:
    tokens = tokenize(_delete(rewrite(text), DIGITS))
    return without_stop_words(F.filter(tokens, lambda w: ~w.rlike(NUMERIC)), stop_words)


def clean(text: Column, stop_words: list[str] | None = STOP_WORDS) -> Column:
    """Full cleaning: rewriting, digits out, tokens, numerals and stop words out.

    A null text becomes an empty one.
    """
    return F.array_join(clean_tokens(F.coalesce(text, F.lit("")), stop_words), " ")


def strip_quote_marks(text: Column) -> Column:
    """Drop one leading ``>`` per line and trim every line."""
    lines = F.transform(F.split(text, "\n"), lambda s: _strip(_delete(s, "^>")))
    return F.array_join(lines, "\n")


def remove_layout(text: Column, separator: str = "\n\n", min_words: int = MIN_WORDS) -> Column:
    """Drop header blocks, signatures with an address or phone, and short paragraphs."""
    plain = strip_quote_marks(_delete(_delete(text, "_x000D_"), "\r"))

    def keep(p: Column) -> Column:
        low = F.lower(p)
        marked = reduce(or_, [low.contains(m) for m in HEADER_MARKS])
        address = F.exists(_all(low, ADDRESS_FOUND, 1), lambda m: m != "")
        return (word_count(p) >= min_words) & ~(marked | low.rlike(PHONE) | address)

    return F.array_join(F.filter(F.split(plain, separator), keep), separator)


def dedup_paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Keep the first of equal paragraphs, in order."""
    return F.array_join(F.array_distinct(F.split(text, separator)), separator)


def remove_short_lines(text: Column, min_words: int = MIN_WORDS) -> Column:
    lines = F.split(F.regexp_replace(text, "\n+", "\n"), "\n")
    return F.array_join(F.filter(lines, lambda s: word_count(s) >= min_words), "\n")


def drop_sentences(text: Column, hit) -> Column:
    """Drop the sentences for which ``hit`` holds; it gets the sentence and its
    lower-case form, which is made once per sentence."""
    pairs = F.transform(split_sentences(text), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    kept = F.filter(pairs, lambda x: ~hit(x["s"], x["low"]))
    return F.array_join(F.transform(kept, lambda x: x["s"]), " ")


def remove_phrases(text: Column, phrases: list[str] = BOILERPLATE, regex: bool = False) -> Column:
    """Drop every sentence holding one of the phrases, whatever their case.

    For a short list kept in code or configuration; a phrase table of any size
    is served by ``operators.lexicon.remove_phrase_table``.
    """
    def hit(s: Column, low: Column) -> Column:
        tests = [s.rlike("(?i)" + p) if regex else low.contains(p.lower()) for p in phrases]
        return reduce(or_, tests, F.lit(False))

    return drop_sentences(text, hit)


def bag_of_words(text: Column, stop_words: list[str] | None = STOP_WORDS) -> Column:
    """Stop words, digits and punctuation out; words joined by one space."""
    kept = F.array_join(without_stop_words(tokenize(text), stop_words), " ")
    letters = F.translate(F.regexp_replace(kept, NON_LETTERS, " "), "_", "")
    return F.array_join(_all(letters, NON_SPACE), " ")


def terms(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of two or more characters."""
    return without_stop_words(_all(F.lower(text), TERM), stop_words)


def with_bigrams(words: Column) -> Column:
    """The words followed by their adjacent pairs."""
    n = F.size(words)
    pairs = F.when(
        n > 1,
        F.zip_with(
            F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def run_lengths(words: Column) -> Column:
    """Distinct words with their counts, sorted: array<struct<term, n>>.

    Counting inside the row needs no shuffle and is linear after one sort.
    """
    # sort_array compares natively; array_sort would call a lambda per comparison.
    ordered = F.sort_array(words)

    def from_sorted(s: Column) -> Column:
        total = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(1), total),
            lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)),
        )

        def counted(ix: Column) -> Column:
            return F.transform(ix, lambda i, j: F.struct(
                F.get(s, i - 1).alias("term"),
                (F.coalesce(F.get(ix, j + 1), total + 1) - i).alias("n"),
            ))

        return F.get(F.transform(F.array(starts), counted), F.lit(0))

    empty = F.array().cast("array<struct<term:string,n:int>>")
    return F.when(F.size(words) > 0, F.get(F.transform(F.array(ordered), from_sorted), F.lit(0))).otherwise(empty)


def dedup_similar_paragraphs(text: Column, separator: str = "\n\n", threshold: float = 0.98) -> Column:
    """Drop a paragraph when a later one has nearly the same word counts.

    Similarity is the cosine of word-count vectors. The search stays inside the
    row and stops at the first later match. A pair is only multiplied out when
    the later paragraph has one of the *lead* words of the earlier one: the
    words left out of the lead hold too little of the vector's length to reach
    the threshold on their own, so nothing is missed.
    """
    limit = threshold * threshold

    def vector(p: Column) -> Column:
        return F.struct(p.alias("text"), run_lengths(_all(F.lower(p), rf"[{WORD}]+")).alias("v"))

    def profile(x: Column) -> Column:
        norm = F.aggregate(x["v"], F.lit(0).cast("long"), lambda a, e: a + e["n"].cast("long") * e["n"])
        return F.struct(
            x["text"].alias("text"), x["v"].alias("v"),
            F.transform(x["v"], lambda e: e["term"]).alias("words"), norm.alias("norm"),
        )

    def lead(x: Column) -> Column:
        # Longest words first: they are the rarest, so the lead discriminates.
        by_length = F.sort_array(F.transform(
            x["v"], lambda e: F.struct((-F.length(e["term"])).alias("l"), e["term"].alias("term"), e["n"].alias("n"))
        ))
        empty = F.array().cast("array<string>")
        taken = F.aggregate(
            by_length,
            F.struct(F.lit(0).cast("long").alias("held"), empty.alias("words")),
            lambda a, e: F.when(
                (x["norm"] - a["held"]).cast("double") >= F.lit(limit) * x["norm"],
                F.struct((a["held"] + e["n"].cast("long") * e["n"]).alias("held"),
                         F.concat(a["words"], F.array(e["term"])).alias("words")),
            ).otherwise(a),
            lambda a: a["words"],
        )
        return F.struct(
            x["text"].alias("text"), x["v"].alias("v"), x["words"].alias("words"),
            x["norm"].alias("norm"), taken.alias("lead"),
        )

    def dot(a: Column, b: Column) -> Column:
        def one(total: Column, e: Column) -> Column:
            at = F.array_position(b["words"], e["term"]).cast("int")
            other = F.get(b["v"], at - 1)["n"].cast("long")
            return total + F.when(at > 0, e["n"].cast("long") * other).otherwise(F.lit(0).cast("long"))
        return F.aggregate(a["v"], F.lit(0).cast("long"), one)

    def similar(a: Column, b: Column) -> Column:
        d = dot(a, b).cast("double")
        return F.when(
            F.arrays_overlap(a["lead"], b["words"]),
            d * d > F.lit(limit) * a["norm"].cast("double") * b["norm"].cast("double"),
        ).otherwise(F.lit(False))

    def search(items: Column) -> Column:
        kept = F.filter(items, lambda a, i: ~F.exists(
            F.slice(items, i + 2, F.size(items)), lambda b: similar(a, b)
        ))
        return F.array_join(F.transform(kept, lambda a: a["text"]), separator)

    parts = F.split(text, separator)
    profiled = F.transform(F.transform(F.transform(parts, vector), profile), lead)
    found = F.get(F.transform(F.array(profiled), search), F.lit(0))
    return F.when(F.size(parts) > 1, found).otherwise(text)


def mask_words(
    pieces: Column, word_ids: Column, key: Column, probability: float, seed: int,
    mask: str = "[MASK]", special: list[str] | None = None,
) -> Column:
    """Mask whole words: struct of masked ``tokens`` and their ``labels``.

    Every piece of a drawn word is masked together; labels are null elsewhere.
    The draw depends on seed, document and word position.
    """
    cut = format(int(probability * 16 ** 8), "08x")
    tag = F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"))

    def drawn(piece: Column, i: Column) -> Column:
        hit = F.substring(F.md5(F.concat(tag, F.get(word_ids, i).cast("string"))), 1, 8) < cut
        return hit & ~piece.isin(special) if special else hit

    return F.struct(
        F.transform(pieces, lambda p, i: F.when(drawn(p, i), F.lit(mask)).otherwise(p)).alias("tokens"),
        F.transform(pieces, lambda p, i: F.when(drawn(p, i), p)).alias("labels"),
    )
