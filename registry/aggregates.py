"""Distributions, statistics, weights, run tables and word counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.rows import SPLIT
from registry.views import (
    EMAILS, TARGET, TARGET_WIDE, TEST_MONTH, VAL_MONTH, emails, r9, table,
)
from threadsieve.functions import text as tx
from threadsieve.operators import distributions, rows, runs, splits

LABELLED = f"labelled AS (SELECT *, {TARGET} AS target, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month FROM emails)"


def _pct(df):
    return df.withColumn("percentage", F.round("percentage", 9))


@query("dist_by_month", f"""WITH {EMAILS}, {LABELLED} SELECT year, month, is_complaint, count(*) AS count,
round(count(*) / sum(count(*)) OVER (PARTITION BY year, month), 9) AS percentage FROM labelled GROUP BY year, month, is_complaint""")
def dist_by_month(spark, d):
    return _pct(distributions.distribution(rows.with_calendar(emails(spark, d)), "is_complaint", ["year", "month"]))


@query("dist_by_split", f"""WITH {EMAILS}, {SPLIT} SELECT data_type, is_complaint, count(*) AS count,
round(count(*) / sum(count(*)) OVER (PARTITION BY data_type), 9) AS percentage FROM split WHERE data_type IS NOT NULL GROUP BY 1, 2""")
def dist_by_split(spark, d):
    split = splits.split_by_month(emails(spark, d), TEST_MONTH, VAL_MONTH)
    return _pct(distributions.distribution(split, "is_complaint", ["data_type"]))


@query("dist_column", f"""WITH {EMAILS} SELECT gcid, count(*) AS count,
round(count(*) / (SELECT count(*) FROM emails), 9) AS percentage FROM emails GROUP BY gcid""")
def dist_column(spark, d):
    return _pct(distributions.distribution(emails(spark, d), "gcid"))


@query("dist_feedback", f"""WITH {EMAILS} SELECT is_feedback, is_complaint, count(*) AS count,
round(count(*) / sum(count(*)) OVER (PARTITION BY is_feedback), 9) AS percentage FROM emails GROUP BY 1, 2""")
def dist_feedback(spark, d):
    return _pct(distributions.distribution(emails(spark, d), "is_complaint", ["is_feedback"]))


LENGTHS = rf"lengths AS (SELECT *, CAST(len(regexp_extract_all(email, '{tx.NON_SPACE}')) AS INTEGER) AS text_length FROM split WHERE data_type IS NOT NULL)"


def _lengths(spark, d):
    split = splits.split_by_month(emails(spark, d, heavy=True), TEST_MONTH, VAL_MONTH)
    return split.withColumn("text_length", tx.word_count(F.col("email")))


_STATS = ", ".join(
    f"round(quantile_cont(text_length, {p / 100}), 6) AS p{p}" for p in distributions.PERCENTS
)
_STATS = f"""count(*) AS n, min(text_length) AS min, max(text_length) AS max, round(avg(text_length), 6) AS mean, {_STATS}"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ["mean", *[f"p{p}" for p in distributions.PERCENTS]]})


@query("length_stats", f"WITH {EMAILS}, {SPLIT}, {LENGTHS} SELECT data_type, {_STATS} FROM lengths GROUP BY data_type")
def length_stats(spark, d):
    return _rounded(distributions.length_statistics(_lengths(spark, d), ["data_type"]))


@query("length_stats_by_class", f"""WITH {EMAILS}, {SPLIT}, {LENGTHS} SELECT data_type, is_complaint, {_STATS} FROM lengths
GROUP BY data_type, is_complaint""")
def length_stats_by_class(spark, d):
    return _rounded(distributions.length_statistics(_lengths(spark, d), ["data_type", "is_complaint"]))


@query("qcut_response", rf"""WITH {EMAILS}, l AS (SELECT CAST(len(regexp_extract_all(email, '{tx.NON_SPACE}')) AS INTEGER) AS text_length,
  {TARGET_WIDE} AS target FROM emails),
q AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS p),
e AS (SELECT DISTINCT quantile_cont(text_length, 0.0) AS edge FROM l UNION SELECT quantile_cont(text_length, 0.2) FROM l
  UNION SELECT quantile_cont(text_length, 0.4) FROM l UNION SELECT quantile_cont(text_length, 0.6) FROM l
  UNION SELECT quantile_cont(text_length, 0.8) FROM l UNION SELECT quantile_cont(text_length, 1.0) FROM l),
o AS (SELECT edge, row_number() OVER (ORDER BY edge) AS rn FROM e),
iv AS (SELECT a.rn AS bin, a.edge AS low, b.edge AS high FROM o a JOIN o b ON b.rn = a.rn + 1)
SELECT CAST(iv.bin AS INTEGER) AS bin, round(low, 6) AS low, round(high, 6) AS high, count(*) AS n, round(avg(target), 9) AS mean_target
FROM l JOIN iv ON (text_length > low AND text_length <= high) OR (iv.bin = 1 AND text_length = low) GROUP BY 1, 2, 3""")
def qcut_response(spark, d):
    lengths = emails(spark, d, heavy=True).select(
        tx.word_count(F.col("email")).alias("text_length"), rows.complaint(True).alias("target")
    )
    return distributions.quantile_bins(lengths, "text_length", "target", 5).select(
        "bin", r9("low", 6), r9("high", 6), "n", r9("mean_target")
    )


@query("class_weights", f"""WITH {EMAILS}, c AS (SELECT {TARGET} AS target, count(*) AS n FROM emails GROUP BY 1),
w AS (SELECT target, n, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight FROM c)
SELECT target, n, round(weight, 9) AS weight, round((SELECT weight FROM w WHERE target = 1) / (SELECT weight FROM w WHERE target = 0), 9)
AS scale_pos_weight FROM w""")
def class_weights(spark, d):
    labelled = emails(spark, d).select(rows.complaint().alias("target"))
    return distributions.class_weights(labelled).select("target", "n", r9("weight"), r9("scale_pos_weight"))


# Every (user, event type) pair stands for one evaluated run of a model.
RUNS = """runs AS (SELECT event_type AS model, user_id AS run, round(avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall,
  round(avg(value), 6) AS score FROM events GROUP BY 1, 2)"""


def _runs(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("run")).agg(
        F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg("value"), 6).alias("score"),
    )


@query("best_run_per_model", f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY recall DESC, run) AS rn FROM runs)
SELECT model, run, recall, score, CASE model WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS place FROM r WHERE rn = 1""")
def best_run_per_model(spark, d):
    best = runs.best_run(_runs(spark, d), ["view", "click", "signup"])
    return best.withColumn("place", F.col("place").cast("int")).orderBy("place", "model")


@query("dedup_metric_rows", f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY model, recall ORDER BY run) AS rn FROM runs)
SELECT model, run, recall, score FROM r WHERE rn = 1""")
def dedup_metric_rows(spark, d):
    return runs.first_per_value(_runs(spark, d), "recall", [F.col("run")], ["model"])


@query("latency_summary", """SELECT event_type AS model, CASE WHEN event_id % 2 = 0 THEN 'gpu' ELSE 'cpu' END AS device, count(*) AS n,
round(sum(value), 6) AS duration, round(count(*) / sum(value), 9) AS throughput, round(sum(value) / count(*), 9) AS latency
FROM events GROUP BY 1, 2""")
def latency_summary(spark, d):
    timed = table(spark, d, "events").select(
        F.col("event_type").alias("model"), F.when(F.col("event_id") % 2 == 0, "gpu").otherwise("cpu").alias("device"),
        F.col("value").alias("duration"),
    )
    return runs.latency_summary(timed, ["model", "device"]).select(
        "model", "device", "n", r9("duration", 6), r9("throughput"), r9("latency")
    )


# A user's event values, scaled, stand for the losses of one epoch.
LOSSES = "losses AS (SELECT user_id AS epoch, event_type AS split, value / 10 AS loss FROM events)"
EPOCHS = """epochs AS (SELECT epoch, split, count(*) AS n, avg(loss) AS mean_loss,
  CASE WHEN avg(loss) > 709.78 THEN 'infinity'::DOUBLE ELSE exp(avg(loss)) END AS perplexity FROM losses GROUP BY 1, 2)"""


def _perplexity(spark, d):
    losses = table(spark, d, "events").select(
        F.col("user_id").alias("epoch"), F.col("event_type").alias("split"), (F.col("value") / 10).alias("loss")
    )
    return runs.perplexity(losses, ["epoch", "split"])


@query("perplexity", f"WITH {LOSSES}, {EPOCHS} SELECT epoch, split, n, round(mean_loss, 8) AS mean_loss, round(ln(perplexity), 8) AS log_perplexity FROM epochs")
def perplexity(spark, d):
    return _perplexity(spark, d).select(
        "epoch", "split", "n", r9("mean_loss", 8), F.round(F.log("perplexity"), 8).alias("log_perplexity")
    )


@query("early_stop_epoch", f"""WITH {LOSSES}, {EPOCHS},
best AS (SELECT a.split, a.epoch, a.perplexity, (SELECT min(b.epoch) FROM epochs b WHERE b.split = a.split AND b.perplexity =
  (SELECT min(c.perplexity) FROM epochs c WHERE c.split = a.split AND c.epoch <= a.epoch)) AS best_epoch FROM epochs a),
stop AS (SELECT s.split, (SELECT min(epoch) FROM best b WHERE b.split = s.split AND epoch - best_epoch > 5) AS stop_epoch FROM (SELECT DISTINCT split FROM best) s),
kept AS (SELECT b.* FROM best b JOIN stop s USING (split) WHERE s.stop_epoch IS NULL OR b.epoch <= s.stop_epoch)
SELECT split, max(best_epoch) AS best_epoch, round(ln(min(perplexity)), 8) AS log_best, max(epoch) AS last_epoch FROM kept GROUP BY split""")
def early_stop_epoch(spark, d):
    stopped = runs.early_stop(_perplexity(spark, d), patience=5, group=["split"])
    return stopped.select("split", "best_epoch", F.round(F.log("best_metric"), 8).alias("log_best"), "last_epoch")


_PROFILED = ["event_id", "user_id", "event_type", "value"]
_EVERY = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _profile_sql(columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", "
        f"CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, "
        f"CASE WHEN count(DISTINCT {c}) = count(*) THEN 1 ELSE 0 END AS is_unique, "
        f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 1 ELSE 0 END AS is_categorical FROM events"
        for c in columns
    )


@query("schema_profile_all", _profile_sql(_EVERY))
def schema_profile_all(spark, d):
    """All columns, times and JSON texts too, from one scan."""
    return distributions.exact_profile(table(spark, d, "events"), _EVERY).drop("type")


@query("schema_profile", _profile_sql(_PROFILED))
def schema_profile(spark, d):
    return distributions.profile(table(spark, d, "events"), _PROFILED, exact=True).drop("type")


@query("schema_profile_approx")
def schema_profile_approx(spark, d):
    return distributions.profile(table(spark, d, "events"), _PROFILED)
