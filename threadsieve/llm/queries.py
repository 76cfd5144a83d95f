"""Queries of the operators over the given tables, by name, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadsieve.llm import chat, collocations, decontamination, langid, lines, mixing, neardup, packing, quality, repair, sharding, suffixes, toxicity
from threadsieve.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_sizes(read(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), 85).drop("_text", "_root")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(langid.learnable(docs))).select(
        "row.doc_id", F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    known = toxicity.sample(docs.where(fold != 1), labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.score(docs, toxicity.fit(known)).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return lines.without_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(spans, " ").alias("removed_spans"),
        F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.format_chats(turns))


@query
def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return suffixes.without_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("kept_bytes"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair.repaired(repair.damaged(read(spark, sf_dir, "conversations")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return fixed.withColumn("repaired_sha256", F.sha2(said, 256)).drop("turns")


@query
def op12_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.packed(read(spark, sf_dir, "documents"), partial(packing.token_ids, path))
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


# The escapes of a text: one more character for each backslash and each control string.
SQL["op8_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS last FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length(role) + len(regexp_extract_all(role, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]')) AS role_chars,
             length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]')) AS text_chars FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN role IS NOT DISTINCT FROM last THEN 7 ELSE 23 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

# The checksum bit by bit, then the cheapest edits row by row over the four states of the role pattern; an inserted
# or changed turn is an assistant's where an even number of turns follows.
SQL["op11_repair"] = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, b)),
    4294967295), 4294967295) % 20 AS hit FROM k),
d AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS c(copy)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM f),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM g),
s AS (SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
step(p, role, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
gap(p, q, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
e AS (
  SELECT conv_id, n, p, p AS q, 2 AS cost, 'D' AS edit FROM r, (VALUES (0), (1), (2), (3)) v(p)
  UNION ALL SELECT conv_id, n, p, q, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM r JOIN step ON step.role = initial WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, n, p, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R' FROM r, step WHERE step.role <> 's' AND fault NOT IN ('blank', 'duplicate')),
w AS (
  SELECT conv_id, 0 AS n, q AS state, {'cost': 5 * k, 'audit': repeat('I', k)} AS best FROM s, gap WHERE p = 0
  UNION ALL
  SELECT w.conv_id, e.n, gap.q, min({'cost': w.best.cost + e.cost + 5 * gap.k, 'audit': w.best.audit || e.edit || repeat('I', gap.k)})
  FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.n + 1 AND e.p = w.state JOIN gap ON gap.p = e.q
  GROUP BY w.conv_id, e.n, gap.q),
b AS (SELECT s.conv_id, min(best) AS best FROM s JOIN w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.n = s.n WHERE state IN (0, 3) GROUP BY s.conv_id),
c AS (SELECT conv_id, i, best.audit[i] AS edit FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS i FROM b)),
t AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n,
    count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY i DESC) - 1 AS after FROM c),
o AS (SELECT t.conv_id, string_agg(CASE WHEN edit = 'K' THEN r.role WHEN after % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
      || CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY i) AS said
  FROM t LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.n = t.n WHERE edit <> 'D' GROUP BY t.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.best.cost, 0) AS BIGINT) AS cost, coalesce(b.best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM a.conv_id"""

# Words of a line, A-Z lowered, joined by one blank, are its digest here.
SQL["op7_lines"] = r"""
WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM documents),
p AS (SELECT doc_id, line, raw,
        CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
        list_filter(regexp_split_to_array(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l),
k AS (SELECT *, array_to_string(words, ' ') AS key, len(words) >= 5 AS unit FROM p),
r AS (SELECT *, unit AND row_number() OVER (PARTITION BY unit, key ORDER BY doc_id, line) > 1 AS gone FROM k),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(start || '-' || (start + length(raw)), ' ' ORDER BY line) FILTER (gone), '') AS removed_spans,
        CASE WHEN count(*) FILTER (gone) = count(*) THEN '' ELSE string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone) END AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_spans, '') AS removed_spans,
  length(coalesce(kept, d.text)) AS kept_chars, md5(coalesce(kept, d.text)) AS kept_md5
FROM documents d LEFT JOIN a USING (doc_id)"""

# All phrases of 1 to 5 words are counted outright; every pair of a candidate and a longer one is tried.
SQL["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, i, words[i:i + k - 1] AS ids FROM w, unnest(range(1, 6)) AS o(k), unnest(range(1, len(words) - k + 2)) AS s(i)),
c AS (SELECT lang, ids, count(*) AS f FROM g GROUP BY lang, ids HAVING count(*) >= 100),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
b AS (SELECT lang, ids, f AS a FROM c WHERE len(ids) > 1 AND NOT EXISTS (
    SELECT 1 FROM c AS d WHERE d.lang = c.lang AND len(d.ids) > len(c.ids) AND 100 * d.f >= 100 * c.f
      AND list_contains(list_transform(range(1, len(d.ids) - len(c.ids) + 2), lambda i: d.ids[i:i + len(c.ids) - 1]), c.ids))),
u AS (SELECT b.lang, b.ids, a, k, h.f AS l, e.f AS r, n, CAST((1000::HUGEINT * a * n) // (h.f::HUGEINT * e.f) AS BIGINT) AS score
  FROM b, unnest(range(1, len(b.ids))) AS o(k), c AS h, c AS e, t
  WHERE h.lang = b.lang AND e.lang = b.lang AND t.lang = b.lang AND h.ids = b.ids[1:k] AND e.ids = b.ids[k + 1:]),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) AS cut FROM u),
x AS (SELECT lang, array_to_string(ids, ' ') AS phrase, a, l, r, n, score FROM m WHERE cut = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM x QUALIFY rank <= 2000"""
