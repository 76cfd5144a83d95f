"""Streams over the fixture tables, run until all that is available is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry import SQL, query
from registry.models import _bundle
from registry.monitoring import LIMITS
from registry.views import MODELS
from threadsieve.schemas import TABLES
from threadsieve.session import scratch_path
from threadsieve.sources import readers
from threadsieve.streaming import scoring


def stream(spark, d, name: str):
    """A table as a stream, be it one file or a folder of parts. A glob, since a stream takes a plain path for a folder."""
    return spark.readStream.schema(TABLES[name]).parquet(f"{d}/{name}.parque[t]")


def finish(spark, df, purpose: str, partition: str | None = None) -> str:
    path = scratch_path(spark, purpose)
    q = scoring.write_stream(df, f"{path}/data", f"{path}/checkpoint", partition)
    q.awaitTermination()
    return f"{path}/data"


def scored_stream(spark, d, model: str = "v0"):
    m, weight, div = MODELS[model]
    hit = F.when(F.col("event_type") == "error", 1).otherwise(0)
    base = ((F.col("event_id") * m) % 10007).cast("double") / 10007
    return stream(spark, d, "events").select(
        F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("thread_id"), F.col("ts").alias("time"),
        hit.alias("target"), ((base + F.lit(weight) * hit) / F.lit(div)).alias("prob"),
    )


def _requests(spark, d):
    body = F.to_json(F.struct(
        F.col("text").alias("email"), F.col("doc_id").cast("string").alias("snapshot_id"),
        F.expr("doc_id div 3").cast("string").alias("thread_id"), F.col("source").alias("gcid"),
        (F.lit(1672531200) + F.col("doc_id") * 60).alias("time"),
    ))
    return stream(spark, d, "documents").select(
        F.when(F.col("doc_id") % 13 == 0, F.lit("{broken")).otherwise(body).alias("value"),
        F.lit("12345").alias("caller_id"),
        F.when(F.col("doc_id") % 7 == 0, "7").otherwise("u1234").alias("user_id"),
        F.concat(F.lit("r-"), F.col("doc_id").cast("string")).alias("request_id"),
    )


@query("stream_score")
def stream_score(spark, d):
    model, threshold = _bundle(spark, d)
    scored = scoring.score_requests(scoring.parse_requests(_requests(spark, d)), model, threshold)
    out = scored.select("request_id", "status", F.array_join("reasons", ",").alias("reasons"),
                        scoring.response_json(scored).alias("response"))
    path = finish(spark, out, "stream-score", "status")
    return spark.read.parquet(path)


_HIT = "(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)"
_PREDICTED = " UNION ALL ".join(
    f"""SELECT '{v}' AS model, strftime(ts, '%Y-%m-%d') AS day, {_HIT} AS target,
  ((CAST((event_id * {m}) % 10007 AS DOUBLE) / 10007 + {weight}::DOUBLE * {_HIT}) / {div}::DOUBLE) > {LIMITS[v]}::DOUBLE AS hit FROM events"""
    for v, (m, weight, div) in MODELS.items()
)


@query("stream_daily_errors", f"""WITH s AS ({_PREDICTED})
SELECT day, model, count(*) AS n, count(*) FILTER (WHERE target = 1) AS positives, count(*) FILTER (WHERE target = 1 AND hit) AS tp,
count(*) FILTER (WHERE target = 0 AND hit) AS fp, count(*) FILTER (WHERE target = 1 AND NOT hit) AS fn FROM s GROUP BY day, model""")
def stream_daily_errors(spark, d):
    parts = [
        scored_stream(spark, d, v).select("time", "target", F.lit(v).alias("model"), (F.col("prob") > limit).alias("hit"))
        for v, limit in LIMITS.items()
    ]
    daily = scoring.daily_error_counts(reduce(DataFrame.unionByName, parts), F.col("hit"), by=("model",))
    path = scratch_path(spark, "stream-daily")
    scoring.write_report(daily, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/data")


@query("stream_dedup", "SELECT event_id AS snapshot_id, user_id AS thread_id FROM events")
def stream_dedup(spark, d):
    # Every message is delivered twice.
    twice = scored_stream(spark, d).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    once = scoring.drop_repeats(twice, ["snapshot_id"])
    return readers.read_shards(spark, finish(spark, once, "stream-dedup")).select("snapshot_id", "thread_id")


@query("stream_latest", """WITH r AS (SELECT user_id AS thread_id, event_id AS snapshot_id,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) SELECT thread_id, snapshot_id FROM r WHERE rn = 1""")
def stream_latest(spark, d):
    latest = scoring.latest_per_thread(scored_stream(spark, d), ["snapshot_id"])
    path = scratch_path(spark, "stream-latest")
    scoring.write_report(latest, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/data")


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query("stream_latest_changes", SQL["stream_latest"])
def stream_latest_changes(spark, d):
    """As ``stream_latest``, from the changes of each batch alone."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    path = scratch_path(spark, "stream-changes")
    try:
        messages = scored_stream(spark, d).select("thread_id", "snapshot_id", "time", F.col("snapshot_id").alias("message"))
        changes = scoring.latest_changes(messages, ["message"])
        scoring.write_batches(changes, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    latest = scoring.read_latest(spark.read.parquet(f"{path}/data"))
    return latest.select("thread_id", F.col("message").alias("snapshot_id"))


@query("stream_requests", """WITH r AS (SELECT 'r-' || CAST(doc_id AS VARCHAR) AS request_id,
CASE WHEN doc_id % 7 = 0 THEN 'user_id' END AS b, CASE WHEN doc_id % 13 = 0 OR text IS NULL THEN 'body' END AS e FROM documents)
SELECT request_id, CASE WHEN b IS NULL AND e IS NULL THEN 'accepted' ELSE 'rejected' END AS status, concat_ws(',', b, e) AS reasons,
b IS NULL AND e IS NULL AS answered FROM r""")
def stream_requests(spark, d):
    """Requests of a stream by status and reasons; only accepted ones have an answer."""
    model, threshold = _bundle(spark, d)
    path = scratch_path(spark, "stream-requests")
    scoring.route_requests(scoring.parse_requests(_requests(spark, d)), model, threshold, path, f"{path}/checkpoint").awaitTermination()
    parts = [spark.read.parquet(f"{path}/{kind}").select("request_id", "status", "reasons", "response") for kind in ("accepted", "rejected")]
    both = parts[0].unionByName(parts[1])
    return both.select("request_id", "status", F.array_join("reasons", ",").alias("reasons"),
                       F.get_json_object("response", "$.pred_1").isNotNull().alias("answered"))
