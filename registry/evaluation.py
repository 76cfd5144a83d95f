"""Curves, thresholds and metrics over scored messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.views import SCORED, r9, scored, scored_sql, table
from threadsieve.operators import evaluation, rows

# Brute force: every threshold of the grid against every distinct score.
BY_SCORE = "hist AS (SELECT prob, count(*) AS n, sum(target) AS pos FROM scored GROUP BY prob)"
CURVE = f"""{BY_SCORE}, grid AS (SELECT i, 0.0::DOUBLE + CAST(i AS DOUBLE) * 0.0001::DOUBLE AS threshold FROM range(0, 10100) t(i)),
tot AS (SELECT sum(target) AS positives FROM scored),
agg AS (SELECT i, threshold, CAST(coalesce(sum(pos), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n), 0) AS BIGINT) AS predicted
  FROM grid LEFT JOIN hist ON hist.prob >= grid.threshold GROUP BY i, threshold),
curve AS (SELECT agg.*, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS precision, tp / positives AS recall,
  2 * tp / (predicted + positives) AS f1 FROM agg, tot)"""


@query("threshold_curve", f"""WITH {SCORED}, {CURVE} SELECT CAST(i AS INTEGER) AS i, round(threshold, 9) AS threshold, tp, predicted,
round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM curve""")
def threshold_curve(spark, d):
    return evaluation.threshold_curve(scored(spark, d)).select(
        "i", r9("threshold"), "tp", "predicted", r9("precision"), r9("recall"), r9("f1")
    )


@query("threshold_curve_positives", f"""WITH s AS (SELECT * FROM (WITH {SCORED} SELECT * FROM scored) WHERE target = 1),
grid AS (SELECT i, CAST(i AS DOUBLE) * 0.0001::DOUBLE AS threshold FROM range(0, 10100) t(i))
SELECT CAST(i AS INTEGER) AS i, count(prob) AS tp, round(count(prob) / (SELECT count(*) FROM s), 9) AS recall
FROM grid LEFT JOIN s ON prob >= threshold GROUP BY i""")
def threshold_curve_positives(spark, d):
    return evaluation.threshold_curve(scored(spark, d), positives_only=True).select("i", "tp", r9("recall"))


_BEST = "row_number() OVER (ORDER BY precision DESC, i DESC)"


@query("best_threshold_recall", f"""WITH {SCORED}, {CURVE}, r AS (SELECT *, {_BEST} AS rn FROM curve WHERE recall > 0.98::DOUBLE)
SELECT 0.98::DOUBLE AS min_recall, round(threshold, 9) AS best_threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM r WHERE rn = 1""")
def best_threshold_recall(spark, d):
    return evaluation.threshold_for_recall(scored(spark, d), 0.98).select(
        "min_recall", r9("best_threshold"), r9("precision"), r9("recall")
    )


@query("best_threshold_f1", f"""WITH {SCORED}, {BY_SCORE}, grid AS (SELECT i, 0.01::DOUBLE + CAST(i AS DOUBLE) * 0.01::DOUBLE AS threshold FROM range(0, 99) t(i)),
f AS (SELECT i, threshold, 2 * coalesce(sum(pos), 0) / (coalesce(sum(n), 0) + (SELECT sum(target) FROM scored)) AS f1
  FROM grid LEFT JOIN hist ON prob >= threshold GROUP BY i, threshold)
SELECT round(threshold, 9) AS best_threshold, round(f1, 9) AS f1 FROM f WHERE f1 > 0 ORDER BY f.f1 DESC, i LIMIT 1""")
def best_threshold_f1(spark, d):
    return evaluation.threshold_for_f1(scored(spark, d)).select(r9("best_threshold"), r9("f1"))


@query("roc_pr_curve", f"""WITH {SCORED}, h AS (SELECT prob, sum(target) AS pos, count(*) - sum(target) AS neg FROM scored GROUP BY prob),
c AS (SELECT prob, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM h WINDOW w AS (ORDER BY prob DESC))
SELECT round(prob, 12) AS threshold, tp, fp, round(tp / (tp + fp), 9) AS precision, round(tp / (SELECT sum(target) FROM scored), 9) AS recall,
round(fp / (SELECT count(*) - sum(target) FROM scored), 9) AS fpr FROM c""")
def roc_pr_curve(spark, d):
    return evaluation.roc_pr_curve(scored(spark, d)).select(
        r9("threshold", 12), "tp", "fp", r9("precision"), r9("recall"), r9("fpr")
    )


def metrics_sql(source: str, label: str, by: str = "") -> str:
    """Confusion counts and rates of a table; ``label`` is the predicted condition."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {keys}n, positives, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fp), 9) END AS precision,
CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fn), 9) END AS recall,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE round(2 * tp / (2 * tp + fp + fn), 9) END AS f1 FROM (SELECT {keys}count(*) AS n,
count(*) FILTER (WHERE target = 1) AS positives, count(*) FILTER (WHERE target = 1 AND {label}) AS tp,
count(*) FILTER (WHERE target = 0 AND {label}) AS fp, count(*) FILTER (WHERE target = 1 AND NOT ({label})) AS fn FROM {source} {group}))"""


def areas_sql(source: str) -> str:
    """ROC AUC by the rank statistic and PR AUC by neighbouring points."""
    return f"""(SELECT (SELECT (sum(rk) FILTER (WHERE target = 1) - count(*) FILTER (WHERE target = 1) * (count(*) FILTER (WHERE target = 1) + 1) / 2.0::DOUBLE)
   / (count(*) FILTER (WHERE target = 1) * count(*) FILTER (WHERE target = 0)) FROM (SELECT target,
   (2.0::DOUBLE * rank() OVER (ORDER BY prob) + count(*) OVER (PARTITION BY prob) - 1) / 2 AS rk FROM {source})) AS roc_auc,
  (SELECT sum((recall - prior_recall) * (precision + prior_precision) / 2) FROM (SELECT recall, precision,
     coalesce(lag(recall) OVER (ORDER BY prob DESC), 0) AS prior_recall, coalesce(lag(precision) OVER (ORDER BY prob DESC), 1) AS prior_precision
     FROM (SELECT prob, sum(pos) OVER w / (SELECT sum(target) FROM {source}) AS recall, sum(pos) OVER w / sum(n) OVER w AS precision
       FROM (SELECT prob, sum(target) AS pos, count(*) AS n FROM {source} GROUP BY prob) WINDOW w AS (ORDER BY prob DESC)))) AS pr_auc)"""


def shown(df, keys=()):
    return df.select(
        *keys, "n", "positives", "tp", "fp", "fn", r9("precision"), r9("recall"), r9("f1"),
        r9("roc_auc"), r9("pr_auc"),
    )


@query("eval_binary", f"""WITH {SCORED} SELECT m.*, round(a.roc_auc, 9) AS roc_auc, round(a.pr_auc, 9) AS pr_auc
FROM {metrics_sql('scored', 'prob > 0.5')} m, {areas_sql('scored')} a""")
def eval_binary(spark, d):
    return shown(evaluation.evaluate(scored(spark, d), 0.5))


_TWO = f"""{SCORED}, {scored_sql('s1', 'v1')}"""


@query("eval_by_model", f"""WITH {_TWO}, {scored_sql('s2', 'v2')} """ + " UNION ALL ".join(
    f"SELECT '{v}' AS model, m.*, round(a.roc_auc, 9) AS roc_auc, round(a.pr_auc, 9) AS pr_auc FROM {metrics_sql(t, 'prob > 0.5')} m, {areas_sql(t)} a"
    for v, t in (("v0", "scored"), ("v1", "s1"), ("v2", "s2"))
))
def eval_by_model(spark, d):
    models = [scored(spark, d, v).withColumn("model", F.lit(v)) for v in ("v0", "v1", "v2")]
    return shown(evaluation.evaluate(models[0].unionByName(models[1]).unionByName(models[2]), 0.5, by=["model"]), ["model"])


RECALLS = [0.8, 0.85, 0.9, 0.95, 0.98, 0.99]

# Calibrated on the first half of the month, tested on the second.
SWEEP = f"""{SCORED.replace('scored AS', 'everything AS')}, scored AS (SELECT * FROM everything WHERE day(time) <= 15),
test AS (SELECT * FROM everything WHERE day(time) > 15), {CURVE},
wanted AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RECALLS)}]) AS min_recall),
best AS (SELECT min_recall, threshold, row_number() OVER (PARTITION BY min_recall ORDER BY precision DESC, i DESC) AS rn FROM curve JOIN wanted ON recall > min_recall),
named AS (SELECT min_recall, threshold FROM best WHERE rn = 1 UNION ALL SELECT NULL, 0.5::DOUBLE),
m AS (SELECT min_recall, threshold, count(*) AS n, count(*) FILTER (WHERE target = 1) AS positives, count(*) FILTER (WHERE target = 1 AND prob > threshold) AS tp,
  count(*) FILTER (WHERE target = 0 AND prob > threshold) AS fp, count(*) FILTER (WHERE target = 1 AND prob <= threshold) AS fn FROM test, named GROUP BY 1, 2),
f AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM m),
sweep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recall ORDER BY min_recall NULLS FIRST) AS rn FROM f) WHERE rn = 1)"""


def _sweep(spark, d):
    everything = scored(spark, d)
    val, test = everything.where(F.dayofmonth("time") <= 15), everything.where(F.dayofmonth("time") > 15)
    return evaluation.recall_sweep(val, test, RECALLS)


@query("recall_sweep", f"""WITH {SWEEP} SELECT min_recall, round(threshold, 9) AS threshold, n, positives, tp, fp, fn, round(precision, 9) AS precision,
round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sweep""")
def recall_sweep(spark, d):
    return _sweep(spark, d).select(
        "min_recall", r9("threshold"), "n", "positives", "tp", "fp", "fn", r9("precision"), r9("recall"), r9("f1")
    ).orderBy("recall")


@query("pr_points", f"""WITH {SWEEP} SELECT min_recall, round(precision, 9) AS precision, round(recall, 9) AS recall,
round(positives / n, 9) AS baseline_precision FROM sweep WHERE recall > 0.9::DOUBLE""")
def pr_points(spark, d):
    return evaluation.pr_points(_sweep(spark, d), 0.9).select(
        "min_recall", r9("precision"), r9("recall"), r9("baseline_precision")
    )


@query("confusion_matrix", f"""WITH {SCORED}, p AS (SELECT target, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS predicted FROM scored),
cells AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(target, predicted))
SELECT c.target, c.predicted, count(p.target) AS n FROM cells c LEFT JOIN p ON c.target = p.target AND c.predicted = p.predicted GROUP BY 1, 2""")
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(rows.apply_threshold(scored(spark, d)))


@query("classification_report", f"""WITH {SCORED}, p AS (SELECT target, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS predicted FROM scored),
k AS (SELECT c AS class, count(*) FILTER (WHERE target = c AND predicted = c)::DOUBLE AS hit, count(*) FILTER (WHERE predicted = c)::DOUBLE AS said,
  count(*) FILTER (WHERE target = c) AS support FROM p, (VALUES (0), (1)) v(c) GROUP BY c),
s AS (SELECT class, hit, support, hit / said AS precision, hit / support AS recall, 2 * hit / (said + support) AS f1 FROM k),
lines AS (SELECT CAST(class AS VARCHAR) AS label, precision, recall, f1, support FROM s
UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM lines""")
def classification_report(spark, d):
    report = evaluation.classification_report(rows.apply_threshold(scored(spark, d)))
    return report.select("label", r9("precision"), r9("recall"), r9("f1"), "support")


SHARES = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
TOP = f"""shares AS (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in SHARES)}]) AS share),
ranked AS (SELECT target, row_number() OVER (ORDER BY prob DESC, md5(CAST(snapshot_id AS VARCHAR))) AS rn FROM scored),
tot AS (SELECT count(*) AS n, CAST(sum(target) AS BIGINT) AS positives FROM scored),
top AS (SELECT share, CAST(floor(share * 100) AS BIGINT) || '%' AS top, n, positives, CAST(floor(n * share) AS BIGINT) AS top_n,
  (SELECT CAST(coalesce(sum(target), 0) AS BIGINT) FROM ranked WHERE rn <= floor(n * share)) AS hits FROM shares, tot)"""


@query("lift_gain", f"WITH {SCORED}, {TOP} SELECT share, top, n, positives, top_n, hits, round(hits / (positives * share), 2) AS gain FROM top")
def lift_gain(spark, d):
    return evaluation.lift_gain(scored(spark, d), SHARES)


@query("response_rate", f"WITH {SCORED}, {TOP} SELECT top, top_n, hits, CASE WHEN top_n > 0 THEN round(hits / top_n, 9) END AS response_rate FROM top")
def response_rate(spark, d):
    return evaluation.response_rate(scored(spark, d), SHARES).select("top", "top_n", "hits", r9("response_rate"))


# Event values repeat a lot, so this ranking has many ties.
_TIED = "scored AS (SELECT event_id AS snapshot_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS target, floor(value / 50) / 10 AS prob FROM events)"


@query("lift_gain_ties", f"WITH {_TIED}, {TOP} SELECT top, top_n, hits, round(hits / (positives * share), 2) AS gain FROM top")
def lift_gain_ties(spark, d):
    tied = table(spark, d, "events").select(
        F.col("event_id").alias("snapshot_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("target"),
        (F.floor(F.col("value") / 50) / 10).alias("prob"),
    )
    return evaluation.lift_gain(tied, SHARES).select("top", "top_n", "hits", "gain")
