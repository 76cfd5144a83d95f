"""Class-imbalance sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.views import EMAILS, TARGET_WIDE, emails
from threadsieve.operators import rows, sampling

_DIGEST = "md5(CAST(snapshot_id AS VARCHAR))"
NUMBERED = f"""l AS (SELECT snapshot_id, gcid, {TARGET_WIDE} AS target FROM emails),
num AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_DIGEST}, snapshot_id) AS pos,
  count(*) OVER (PARTITION BY target) AS n FROM l)"""
_DRAW = "('0x' || substr(md5('101:' || CAST(draw AS VARCHAR)), 1, 15))::BIGINT"


def _drawn(draws: str) -> str:
    return f"""WITH {EMAILS}, {NUMBERED}, draws AS ({draws}),
slots AS (SELECT draw, {_DRAW} % (SELECT max(n) FROM num WHERE target = 0) + 1 AS pos FROM draws)
SELECT snapshot_id, gcid, target, NULL::BIGINT AS draw FROM num WHERE target = 1 UNION ALL
SELECT n.snapshot_id, n.gcid, n.target, s.draw FROM slots s JOIN num n ON n.target = 0 AND n.pos = s.pos"""


def _labelled(spark, d):
    return emails(spark, d).select("snapshot_id", "gcid", rows.complaint(True).alias("target"))


@query("undersample_ratio", _drawn("SELECT unnest(range(0, (SELECT max(n) * 5 FROM num WHERE target = 1))) AS draw"))
def undersample_ratio(spark, d):
    return sampling.undersample_ratio(_labelled(spark, d), 5, 101)


@query("undersample_n", _drawn("SELECT unnest(range(0, 200)) AS draw"))
def undersample_n(spark, d):
    return sampling.undersample_n(_labelled(spark, d), 200, 101)


@query("sample_prevalence", f"""WITH {EMAILS}, l AS (SELECT snapshot_id, {TARGET_WIDE} AS target,
row_number() OVER (ORDER BY md5('101:' || CAST(snapshot_id AS VARCHAR))) AS rn FROM emails)
SELECT snapshot_id, target FROM l WHERE rn <= (SELECT sum(target) * 6 FROM l)""")
def sample_prevalence(spark, d):
    return sampling.sample_prevalence(_labelled(spark, d), 5, 101).select("snapshot_id", "target")


@query("sample_n", f"""WITH {EMAILS} SELECT snapshot_id, gcid FROM emails ORDER BY md5('101:' || CAST(snapshot_id AS VARCHAR)) LIMIT 20""")
def sample_n(spark, d):
    return sampling.sample_rows(emails(spark, d).select("snapshot_id", "gcid"), 20, 101)
