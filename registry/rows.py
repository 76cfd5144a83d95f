"""Filters, derived columns, joins, threads, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.views import (
    EMAILS, SCORED, TARGET, TARGET_WIDE, TEST_MONTH, VAL_MONTH, emails, scored, scored_sql, table,
)
from threadsieve.functions import text as tx
from threadsieve.operators import evaluation, lexicon, monitoring, rows, splits, threads

STAMP = "strftime(time, '%Y-%m-%d %H:%M:%S')"


def stamp(c: str = "time"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("flt_nonempty", f"WITH {EMAILS} SELECT snapshot_id, gcid FROM emails WHERE email IS NOT NULL AND length(email) > 0")
def flt_nonempty(spark, d):
    return rows.nonempty(emails(spark, d)).select("snapshot_id", "gcid")


@query("flt_closed", f"WITH {EMAILS} SELECT snapshot_id, state FROM emails WHERE state = 'closed'")
def flt_closed(spark, d):
    return rows.in_state(emails(spark, d)).select("snapshot_id", "state")


@query("flt_window", f"""WITH {EMAILS} SELECT snapshot_id, {STAMP} AS time FROM emails
WHERE time >= TIMESTAMP '2023-01-01 00:00:00' AND time <= TIMESTAMP '2023-06-30 00:00:00'""")
def flt_window(spark, d):
    return rows.in_window(emails(spark, d), "2023-01-01", "2023-06-30").select("snapshot_id", stamp())


@query("flt_exclude_month", f"""WITH {EMAILS} SELECT snapshot_id, {STAMP} AS time FROM emails
WHERE NOT (year(time) = 2022 AND month(time) = 8)""")
def flt_exclude_month(spark, d):
    return rows.exclude_months(emails(spark, d), [(2022, 8)]).select("snapshot_id", stamp())


@query("prj_calendar", f"""WITH {EMAILS} SELECT snapshot_id, CAST(year(time) AS INTEGER) AS year,
CAST(month(time) AS INTEGER) AS month, CAST(day(time) AS INTEGER) AS day FROM emails""")
def prj_calendar(spark, d):
    return rows.with_calendar(emails(spark, d)).select("snapshot_id", "year", "month", "day")


@query("prj_quotes", f"""WITH {EMAILS} SELECT snapshot_id,
replace(replace(email, '`', ''''), '’', '''') AS email FROM emails""")
def prj_quotes(spark, d):
    return emails(spark, d).select("snapshot_id", tx.normalise_quotes(F.col("email")).alias("email"))


@query("prj_target", f"WITH {EMAILS} SELECT snapshot_id, {TARGET} AS target, {TARGET_WIDE} AS target_feedback FROM emails")
def prj_target(spark, d):
    return emails(spark, d).select(
        "snapshot_id", rows.complaint().alias("target"), rows.complaint(True).alias("target_feedback")
    )


SPLIT = f"""split AS (SELECT *, CASE WHEN date_trunc('month', time) = DATE '2023-08-01' THEN 'test'
  WHEN date_trunc('month', time) = DATE '2023-07-01' THEN 'val'
  WHEN date_trunc('month', time) < DATE '2023-07-01' THEN 'train' END AS data_type FROM emails)"""


@query("split_by_month", f"""WITH {EMAILS}, {SPLIT} SELECT snapshot_id, data_type FROM split WHERE data_type IS NOT NULL""")
def split_by_month(spark, d):
    return splits.split_by_month(emails(spark, d), TEST_MONTH, VAL_MONTH).select("snapshot_id", "data_type")


@query("split_train_test", f"""WITH {EMAILS} SELECT snapshot_id, CASE WHEN time < DATE '2023-08-01' THEN 'train'
ELSE 'test' END AS data_type FROM emails WHERE time < DATE '2023-09-01'""")
def split_train_test(spark, d):
    return splits.split_by_month(emails(spark, d), TEST_MONTH).select("snapshot_id", "data_type")


@query("prj_target_by_split", f"""WITH {EMAILS}, {SPLIT} SELECT snapshot_id, data_type,
CASE WHEN data_type = 'test' THEN {TARGET} ELSE {TARGET_WIDE} END AS target FROM split WHERE data_type IS NOT NULL""")
def prj_target_by_split(spark, d):
    split = splits.split_by_month(emails(spark, d), TEST_MONTH, VAL_MONTH)
    return split.select("snapshot_id", "data_type", rows.target_by_split().alias("target"))


@query("prj_rename", f"""WITH {EMAILS} SELECT snapshot_id AS snapshot_id, gcid AS client_key, {TARGET} AS is_complaint_flag FROM emails""")
def prj_rename(spark, d):
    spaced = emails(spark, d).select(
        F.col("snapshot_id").alias("snapshot id"), F.col("gcid").alias("client key"),
        rows.complaint().alias("is complaint flag"),
    )
    return rows.underscore_names(spaced)


@query("apply_threshold", f"""WITH {SCORED} SELECT snapshot_id, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS predicted_label,
CASE WHEN prob > 0.5 THEN 'Complaint' ELSE 'Non-Complaint' END AS pred_response,
round(prob, 9) AS pred_1, round(1 - prob, 9) AS pred_0 FROM scored""")
def apply_threshold(spark, d):
    return rows.apply_threshold(scored(spark, d)).select(
        "snapshot_id", "predicted_label", "pred_response",
        F.round("pred_1", 9).alias("pred_1"), F.round("pred_0", 9).alias("pred_0"),
    )


@query("bucket_length_all", rf"""SELECT doc_id AS snapshot_id, CASE WHEN text IS NULL THEN 'none' WHEN len(regexp_extract_all(text, '{tx.NON_SPACE}')) <= 512
THEN '<=512' ELSE '>512' END AS bucket FROM documents""")
def bucket_length_all(spark, d):
    """With a bucket of their own for missing texts."""
    docs = table(spark, d, "documents", "doc_id")
    words = F.when(F.col("text").isNotNull(), tx.word_count(F.col("text")))
    return docs.select(F.col("doc_id").alias("snapshot_id"), F.coalesce(rows.length_bucket(words), F.lit("none")).alias("bucket"))


@query("bucket_length", rf"""SELECT doc_id AS snapshot_id, CASE WHEN len(regexp_extract_all(text, '{tx.NON_SPACE}')) <= 512
THEN '<=512' ELSE '>512' END AS bucket FROM documents WHERE text IS NOT NULL""")
def bucket_length(spark, d):
    docs = table(spark, d, "documents", "doc_id").where(F.col("text").isNotNull())
    return docs.select(
        F.col("doc_id").alias("snapshot_id"), rows.length_bucket(tx.word_count(F.col("text"))).alias("bucket")
    )


@query("slice_errors", f"""WITH {SCORED} SELECT snapshot_id, CASE WHEN target = 0 THEN 'false_positive' ELSE 'false_negative' END AS slice
FROM scored WHERE (target = 0 AND prob > 0.5) OR (target = 1 AND prob <= 0.5)""")
def slice_errors(spark, d):
    labelled = rows.apply_threshold(scored(spark, d))
    kinds = ("false_positive", "false_negative")
    first, second = (
        rows.error_slice(labelled, k).select("snapshot_id", F.lit(k).alias("slice")) for k in kinds
    )
    return first.unionByName(second)


@query("score_empty_route", rf"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^0-9?]', '', 'g') AS kept FROM conversations)
SELECT conv_id, turn, CASE WHEN kept IS NULL OR kept = '' THEN 0.0::DOUBLE
ELSE CAST(length(kept) AS DOUBLE) / (1 + length(kept)) END AS prob_pred FROM c""")
def score_empty_route(spark, d):
    # Only questions and figures are kept, so that many messages end up empty.
    kept = table(spark, d, "conversations", "conv_id").withColumn(
        "preprocessed_email", F.regexp_replace("text", "[^0-9?]", "")
    )
    n = F.length("preprocessed_email")
    scorer = lambda df: df.withColumn("prob_pred", n.cast("double") / (1 + n))
    return rows.route_empty(kept, scorer).select("conv_id", "turn", "prob_pred")


@query("validate_rules", r"""WITH r AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS caller_id,
         substr(event_type, 1, 1) || CAST(event_id % 5000 AS VARCHAR) AS user_id,
         event_type || CASE WHEN event_id % 7 = 0 THEN '_' ELSE '-' END || CAST(event_id AS VARCHAR) AS request_id,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS email FROM events),
checked AS (SELECT event_id,
         CASE WHEN NOT regexp_matches(caller_id, '^[0-9]{1,10}$') THEN 'caller_id' END AS a,
         CASE WHEN NOT regexp_matches(user_id, '^[a-zA-Z]{1}[0-9]{3,10}$') THEN 'user_id' END AS b,
         CASE WHEN NOT regexp_matches(request_id, '^[0-9a-zA-Z-]{1,60}$') THEN 'request_id' END AS c,
         CASE WHEN email IS NULL THEN 'body' END AS e FROM r)
SELECT event_id, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL AND e IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
       concat_ws(',', a, b, c, e) AS reasons FROM checked""")
def validate_rules(spark, d):
    requests = table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("caller_id"),
        F.concat(F.substring("event_type", 1, 1), (F.col("event_id") % 5000).cast("string")).alias("user_id"),
        F.concat("event_type", F.when(F.col("event_id") % 7 == 0, "_").otherwise("-"),
                 F.col("event_id").cast("string")).alias("request_id"),
        F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("email"),
        F.col("event_id").alias("snapshot_id"), F.col("ts").alias("time"),
    )
    checked = rows.validate(requests, rows.request_rules())
    return checked.select(
        "event_id", F.when(F.size("reasons") == 0, "accepted").otherwise("rejected").alias("status"),
        F.array_join("reasons", ",").alias("reasons"),
    )


@query("join_predictions", f"""WITH {SCORED}, {scored_sql('other', 'v1')}
SELECT s.snapshot_id, s.thread_id, round(s.prob, 9) AS prob, round(o.prob, 9) AS predicted_prob
FROM scored s JOIN other o ON s.snapshot_id = o.snapshot_id AND s.thread_id = o.thread_id AND s.time = o.time""")
def join_predictions(spark, d):
    other = scored(spark, d, "v1").select("snapshot_id", "thread_id", "time", F.col("prob").alias("predicted_prob"))
    return monitoring.join_predictions(scored(spark, d), other, ["snapshot_id", "thread_id", "time"]).select(
        "snapshot_id", "thread_id", F.round("prob", 9).alias("prob"),
        F.round("predicted_prob", 9).alias("predicted_prob"),
    )


ALIGNED = f"""{SCORED}, {scored_sql('s1', 'v1')}, {scored_sql('s2', 'v2')},
aligned AS (SELECT a.snapshot_id, a.thread_id, a.time, a.target, a.prob AS prob_v0, b.prob AS prob_v1, c.prob AS prob_v2
FROM scored a JOIN s1 b USING (snapshot_id, thread_id, time, target) JOIN s2 c USING (snapshot_id, thread_id, time, target))"""


def aligned(spark, d):
    models = {v: scored(spark, d, v) for v in ("v0", "v1", "v2")}
    return monitoring.align_models(models, ["snapshot_id", "thread_id", "time", "target"], ["prob"])


@query("join_three_models", f"""WITH {ALIGNED} SELECT snapshot_id, target, round(prob_v0, 9) AS prob_v0,
round(prob_v1, 9) AS prob_v1, round(prob_v2, 9) AS prob_v2 FROM aligned""")
def join_three_models(spark, d):
    return aligned(spark, d).select(
        "snapshot_id", "target", *[F.round(f"prob_{v}", 9).alias(f"prob_{v}") for v in ("v0", "v1", "v2")]
    )


@query("dedup_latest", f"""WITH {EMAILS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY time DESC, snapshot_id) AS rn
FROM emails WHERE thread_id IS NOT NULL) SELECT thread_id, snapshot_id, {STAMP} AS time FROM r WHERE rn = 1""")
def dedup_latest(spark, d):
    return threads.latest_per_thread(emails(spark, d)).select("thread_id", "snapshot_id", stamp())


@query("dedup_latest_turn", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS rn FROM conversations)
SELECT conv_id, turn, role, text FROM r WHERE rn = 1""")
def dedup_latest_turn(spark, d):
    return threads.latest_per_thread(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("dedup_target", f"""WITH {EMAILS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id
ORDER BY is_complaint DESC NULLS LAST, time DESC, snapshot_id) AS rn FROM emails)
SELECT thread_id, snapshot_id, is_complaint FROM r WHERE rn = 1""")
def dedup_target(spark, d):
    return threads.complaint_first_per_thread(emails(spark, d)).select("thread_id", "snapshot_id", "is_complaint")


NEWEST = f"""r AS (SELECT snapshot_id, time, {TARGET} AS target,
  row_number() OVER (PARTITION BY {TARGET} ORDER BY time DESC, md5(CAST(snapshot_id AS VARCHAR))) AS rn,
  count(*) OVER (PARTITION BY {TARGET}) AS n FROM emails)"""


@query("split_val_time", f"""WITH {EMAILS}, {NEWEST} SELECT snapshot_id, target,
CASE WHEN rn <= floor(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS data_type FROM r""")
def split_val_time(spark, d):
    labelled = emails(spark, d).select("snapshot_id", "time", rows.complaint().alias("target"))
    return splits.split_newest(labelled, 0.2).select("snapshot_id", "target", "data_type")


@query("split_val_random", f"""WITH {EMAILS}, r AS (SELECT snapshot_id, {TARGET} AS target,
  row_number() OVER (PARTITION BY {TARGET} ORDER BY md5('101:' || CAST(snapshot_id AS VARCHAR))) AS rn,
  count(*) OVER (PARTITION BY {TARGET}) AS n FROM emails)
SELECT snapshot_id, target, CASE WHEN rn <= floor(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS data_type FROM r""")
def split_val_random(spark, d):
    labelled = emails(spark, d).select("snapshot_id", rows.complaint().alias("target"))
    return splits.split_shuffled(labelled, 0.2, 101)


@query("split_random", f"""WITH {EMAILS} SELECT snapshot_id,
CASE WHEN CAST(('0x' || substr(md5('101:' || CAST(snapshot_id AS VARCHAR)), 1, 15))::BIGINT AS DOUBLE) / 1152921504606846976.0::DOUBLE < 0.2::DOUBLE
THEN 'test' ELSE 'train' END AS data_type FROM emails""")
def split_random(spark, d):
    return splits.split_random(emails(spark, d), 0.2, 101).select("snapshot_id", "data_type")


@query("shard_ntile", f"""WITH {EMAILS} SELECT snapshot_id,
CAST(ntile(10) OVER (ORDER BY time, md5(CAST(snapshot_id AS VARCHAR))) - 1 AS INTEGER) AS shard FROM emails""")
def shard_ntile(spark, d):
    return splits.shard(emails(spark, d).select("snapshot_id", "time"), 10).select("snapshot_id", "shard")


@query("sort_metrics", """SELECT event_type AS model, round(avg(value), 6) AS metric FROM events GROUP BY 1 ORDER BY 2, 1""")
def sort_metrics(spark, d):
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.round(F.avg("value"), 6).alias("metric")
    )
    return runs.orderBy("metric", "model")


@query("topk_scores", f"""WITH {SCORED} SELECT snapshot_id, target, round(prob, 9) AS prob FROM scored
ORDER BY scored.prob DESC, snapshot_id LIMIT 100""")
def topk_scores(spark, d):
    return evaluation.top_scores(scored(spark, d), 100).select("snapshot_id", "target", F.round("prob", 9).alias("prob"))


@query("union_splits", f"""WITH {EMAILS}, {SPLIT} SELECT snapshot_id, data_type, CASE WHEN data_type = 'train' THEN 1 END AS fold FROM split
WHERE data_type IS NOT NULL""")
def union_splits(spark, d):
    split = splits.split_by_month(emails(spark, d), TEST_MONTH, VAL_MONTH).select("snapshot_id", "data_type")
    train = split.where("data_type = 'train'").withColumn("fold", F.lit(1))
    others = [split.where(F.col("data_type") == k) for k in ("val", "test")]
    return train.unionByName(others[0], allowMissingColumns=True).unionByName(others[1], allowMissingColumns=True)


WORDS = rf"""w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '{tx.TERM}')) AS word FROM documents)"""


@query("except_words", f"""WITH {WORDS} SELECT word FROM w WHERE lang = 'en' EXCEPT SELECT word FROM w WHERE lang <> 'en'""")
def except_words(spark, d):
    words = table(spark, d, "documents", "doc_id").select("lang", F.explode(tx.terms(F.col("text"))).alias("word"))
    english = words.where("lang = 'en'").select("word").distinct()
    return lexicon.words_not_in(english, words.where("lang <> 'en'").select("word").distinct(), listed=False)


@query("intersect_words", f"""WITH {WORDS} SELECT word FROM w WHERE lang = 'en' INTERSECT SELECT word FROM w WHERE lang <> 'en'""")
def intersect_words(spark, d):
    words = table(spark, d, "documents", "doc_id").select("lang", F.explode(tx.terms(F.col("text"))).alias("word"))
    return words.where("lang = 'en'").select("word").intersect(words.where("lang <> 'en'").select("word"))
