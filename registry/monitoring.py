"""Calibration across periods and model comparison by month and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.evaluation import areas_sql, metrics_sql
from registry.rows import ALIGNED, aligned
from registry.views import EMAILS, SCORED, emails, r9, scored, scored_sql
from threadsieve.functions import text as tx
from threadsieve.operators import evaluation, monitoring, rows

MIN_RECALL = 0.9
HALF = "CASE WHEN day(time) <= 15 THEN 0 ELSE 1 END"


def half():
    return F.when(F.dayofmonth("time") <= 15, 0).otherwise(1)


def calibrated_sql(name: str, source: str) -> str:
    """Threshold of the first half of the month for a scored table."""
    return f"""{name} AS (SELECT threshold FROM (SELECT i, threshold, sum(CASE WHEN prob >= threshold THEN target ELSE 0 END) AS tp,
  count(*) FILTER (WHERE prob >= threshold) AS predicted, sum(target) AS positives
  FROM (SELECT i, CAST(i AS DOUBLE) * 0.0001::DOUBLE AS threshold FROM range(0, 10100) t(i)), (SELECT * FROM {source} WHERE day(time) <= 15)
  GROUP BY i, threshold) WHERE tp / positives > {MIN_RECALL}::DOUBLE ORDER BY CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END DESC, i DESC LIMIT 1)"""


@query("calibrate_apply", f"""WITH {SCORED}, {calibrated_sql('best', 'scored')}
SELECT snapshot_id, target, round(threshold, 9) AS best_threshold, CASE WHEN prob > threshold THEN 1 ELSE 0 END AS predicted_label
FROM scored, best WHERE day(time) > 15""")
def calibrate_apply(spark, d):
    halves = scored(spark, d).withColumn("period", half())
    applied = monitoring.calibrate_and_apply(halves, "period", MIN_RECALL)
    labelled = rows.apply_threshold(applied, "prob", F.col("best_threshold"))
    return labelled.where("period = 1").select("snapshot_id", "target", r9("best_threshold"), "predicted_label")


@query("frozen_vs_refreshed", f"""WITH {SCORED}, {scored_sql('s1', 'v1')}, {calibrated_sql('b0', 'scored')}, {calibrated_sql('b1', 's1')},
pair AS (SELECT 'frozen' AS model, target, prob, (SELECT threshold FROM b0) AS threshold FROM scored WHERE day(time) > 15
  UNION ALL SELECT 'refreshed', target, prob, (SELECT threshold FROM b1) FROM s1 WHERE day(time) > 15)
SELECT * FROM {metrics_sql('pair', 'prob > threshold', 'model')}""")
def frozen_vs_refreshed(spark, d):
    named = {"frozen": "v0", "refreshed": "v1"}
    parts = [
        scored(spark, d, v).withColumns({"period": half(), "model": F.lit(name)}) for name, v in named.items()
    ]
    applied = monitoring.calibrate_and_apply(parts[0].unionByName(parts[1]), "period", MIN_RECALL, by=["model"])
    result = evaluation.evaluate(applied.where("period = 1"), F.col("best_threshold"), by=["model"])
    return result.select("model", "n", "positives", "tp", "fp", "fn", r9("precision"), r9("recall"), r9("f1"))


@query("frozen_vs_refreshed_areas", f"""WITH {SCORED}, {scored_sql('s1', 'v1')}, {calibrated_sql('b0', 'scored')}, {calibrated_sql('b1', 's1')},
old AS (SELECT * FROM scored WHERE day(time) > 15), new AS (SELECT * FROM s1 WHERE day(time) > 15),
pair AS (SELECT 'frozen' AS model, target, prob, (SELECT threshold FROM b0) AS threshold FROM old
  UNION ALL SELECT 'refreshed', target, prob, (SELECT threshold FROM b1) FROM new),
under AS (SELECT 'frozen' AS model, * FROM {areas_sql('old')} a UNION ALL SELECT 'refreshed', * FROM {areas_sql('new')} a)
SELECT m.*, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM {metrics_sql('pair', 'prob > threshold', 'model')} m JOIN under USING (model)""")
def frozen_vs_refreshed_areas(spark, d):
    """The comparison with both areas under the curves."""
    named = {"frozen": "v0", "refreshed": "v1"}
    parts = [scored(spark, d, v).withColumns({"period": half(), "model": F.lit(name)}) for name, v in named.items()]
    applied = monitoring.calibrate_and_apply(parts[0].unionByName(parts[1]), "period", MIN_RECALL, by=["model"])
    result = evaluation.evaluate(applied.where("period = 1"), F.col("best_threshold"), by=["model"])
    return result.select(
        "model", "n", "positives", "tp", "fp", "fn", r9("precision"), r9("recall"), r9("f1"), r9("roc_auc"), r9("pr_auc"))


LIMITS = {"v0": 0.4, "v1": 0.5, "v2": 0.3}


def predictions():
    return {v: F.col(f"prob_{v}") > t for v, t in LIMITS.items()}


def long_sql(by: str = "") -> str:
    """Counts per model, one model at a time."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    named = {monitoring.BASELINE: "TRUE", **{v: f"prob_{v} > {t}" for v, t in LIMITS.items()}}
    return " UNION ALL ".join(
        f"""SELECT {keys}'{name}' AS model, count(*) AS n, count(*) FILTER (WHERE target = 1) AS positives,
count(*) FILTER (WHERE target = 1 AND {c}) AS tp, count(*) FILTER (WHERE target = 0 AND {c}) AS fp,
count(*) FILTER (WHERE target = 1 AND NOT ({c})) AS fn FROM aligned {group}""" for name, c in named.items()
    )


@query("monitor_month", f"""WITH {ALIGNED}, m AS ({long_sql()}) SELECT model, round(tp / (tp + fp), 9) AS precision,
round(tp / (tp + fn), 9) AS recall, fp, fn FROM m""")
def monitor_month(spark, d):
    return monitoring.month_comparison(aligned(spark, d), predictions()).select(
        "model", r9("precision"), r9("recall"), "fp", "fn"
    )


@query("monitor_reduction", f"WITH {ALIGNED}, m AS ({long_sql()}) SELECT model, n, tp + fp AS predicted, round(1 - (tp + fp) / n, 9) AS reduction FROM m")
def monitor_reduction(spark, d):
    return monitoring.workload_reduction(aligned(spark, d), predictions()).select("model", "n", "predicted", r9("reduction"))


DAILY = f"{ALIGNED.replace('aligned AS', 'base AS')}, aligned AS (SELECT *, strftime(time, '%Y-%m-%d') AS day FROM base), m AS ({long_sql('day')})"


def _daily(spark, d):
    days = aligned(spark, d).withColumn("day", F.date_format("time", "yyyy-MM-dd"))
    return monitoring.compare_models(days, predictions(), by=["day"])


@query("monitor_daily_pr", f"""WITH {DAILY} SELECT day, model, CASE WHEN positives = 0 OR tp + fp = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fp), 9) END AS precision,
CASE WHEN positives = 0 THEN 1.0::DOUBLE ELSE round(tp / positives, 9) END AS recall FROM m""")
def monitor_daily_pr(spark, d):
    return monitoring.daily_rates(_daily(spark, d), ["day"]).select("day", "model", r9("precision"), r9("recall"))


ERRORS = "e AS (SELECT day, model, CASE WHEN positives = 0 THEN 0 ELSE fp END AS fp, CASE WHEN positives = 0 THEN 0 ELSE fn END AS fn FROM m)"


@query("monitor_daily_errors", f"WITH {DAILY}, {ERRORS} SELECT day, model, fp, fn FROM e")
def monitor_daily_errors(spark, d):
    return monitoring.daily_errors(_daily(spark, d), ["day"])


@query("monitor_fp_reduction", f"""WITH {DAILY}, {ERRORS}, w AS (SELECT day, model, fp, max(CASE WHEN model = '{monitoring.BASELINE}' THEN fp END) OVER (PARTITION BY day) AS baseline_fp FROM e)
SELECT day, model, fp, baseline_fp, CASE WHEN baseline_fp <> 0 THEN round((baseline_fp - fp) / baseline_fp * 100, 6) END AS reduction_pct
FROM w WHERE model <> '{monitoring.BASELINE}'""")
def monitor_fp_reduction(spark, d):
    errors = monitoring.daily_errors(_daily(spark, d), ["day"])
    return monitoring.false_positive_reduction(errors, ["day"]).select(
        "day", "model", "fp", "baseline_fp", r9("reduction_pct", 6)
    )


# Messages scored by a simple rule on their length, for the error slices.
_SLICED = rf"""{EMAILS}, l AS (SELECT snapshot_id, CASE WHEN is_complaint = 'Y' THEN 1 ELSE 0 END AS target, is_feedback,
  len(regexp_extract_all(email, '{tx.NON_SPACE}')) AS words FROM emails),
p AS (SELECT *, CASE WHEN words > 100 THEN 1 ELSE 0 END AS predicted_label, CASE WHEN words <= 512 THEN '<=512' WHEN words > 512 THEN '>512' END AS bucket FROM l),
s AS (SELECT 'all' AS slice, * FROM p UNION ALL SELECT 'false_positive', * FROM p WHERE target = 0 AND predicted_label = 1
  UNION ALL SELECT 'false_negative', * FROM p WHERE target = 1 AND predicted_label = 0)"""


@query("slice_distribution", f"""WITH {_SLICED}, u AS (SELECT slice, 'bucket' AS measure, bucket AS value FROM s UNION ALL SELECT slice, 'is_feedback', is_feedback FROM s),
c AS (SELECT slice, measure, value, count(*) AS n FROM u GROUP BY slice, measure, value)
SELECT slice, measure, value, n AS count, round(n / sum(n) OVER (PARTITION BY slice, measure), 9) AS percentage FROM c""")
def slice_distribution(spark, d):
    words = tx.word_count(F.col("email"))
    labelled = emails(spark, d, heavy=True).select(
        "is_feedback", rows.complaint().alias("target"), words.alias("words"),
    ).withColumns({
        "predicted_label": F.when(F.col("words") > 100, 1).otherwise(0), "bucket": rows.length_bucket(F.col("words")),
    })
    found = monitoring.slice_distributions(labelled, ["bucket", "is_feedback"])
    return found.withColumn("percentage", F.round("percentage", 9))
