"""Sources and sinks: what was written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.rows import STAMP, stamp
from registry.text import DICTIONARY, dictionary
from registry.views import EMAILS, SCORED, emails, scored, table
from threadsieve.operators import rows, splits
from threadsieve.schemas import MESSAGE
from threadsieve.session import scratch_path
from threadsieve.sources import readers, writers


def _extracts(spark, d):
    """Monthly CSV extracts of the messages."""
    path = scratch_path(spark, "extracts")
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE.fields if f.name != "supervised_groups"]
    frame = emails(spark, d).select(
        *fields, F.lit(None).cast("string").alias("supervised_groups"), F.date_format("time", "MMyy").alias("email_data"),
    ).select(*[f.name for f in MESSAGE.fields], "email_data")
    (
        frame.repartition("email_data").write.partitionBy("email_data")
        .option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    )
    return path


@query("src_month_counts", f"WITH {EMAILS} SELECT strftime(time, '%m%y') AS month_token, count(*) AS n FROM emails GROUP BY 1")
def src_month_counts(spark, d):
    return readers.month_counts(readers.read_extracts(spark, _extracts(spark, d)))


@query("src_one_month", f"""WITH {EMAILS} SELECT CAST(snapshot_id AS VARCHAR) AS snapshot_id, gcid, {STAMP} AS time, email FROM emails
WHERE strftime(time, '%m%y') = '0823'""")
def src_one_month(spark, d):
    month = readers.read_extracts(spark, _extracts(spark, d), month="0823")
    return month.select("snapshot_id", "gcid", stamp(), "email")


@query("src_parquet_roundtrip", f"WITH {EMAILS} SELECT snapshot_id, gcid, {STAMP} AS time, is_complaint, email FROM emails")
def src_parquet_roundtrip(spark, d):
    path = writers.write_shards(emails(spark, d), scratch_path(spark, "shards"), 10)
    return readers.read_shards(spark, path).select("snapshot_id", "gcid", stamp(), "is_complaint", "email")


@query("union_shards", f"WITH {EMAILS} SELECT snapshot_id, thread_id, state FROM emails")
def union_shards(spark, d):
    sharded = splits.shard(emails(spark, d).select("snapshot_id", "thread_id", "state", "time"), 4)
    path = writers.write_shards(sharded, scratch_path(spark, "shards"), by="shard")
    return readers.read_shards(spark, path).select("snapshot_id", "thread_id", "state")


@query("sink_predictions", f"""WITH {SCORED} SELECT CAST(snapshot_id AS VARCHAR) AS snapshot_id, CAST(thread_id AS VARCHAR) AS thread_id, target AS "True_label",
CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS "Predicted_label", round(prob, 9) AS "Predicted_prob", 0.5::DOUBLE AS best_threshold, 0.9::DOUBLE AS min_recall FROM scored""")
def sink_predictions(spark, d):
    labelled = rows.apply_threshold(scored(spark, d))
    predictions = labelled.select(
        F.lit(0.9).alias("min_recall"), "snapshot_id", "thread_id", "time", F.col("target").alias("True_label"),
        F.col("predicted_label").alias("Predicted_label"), F.round("prob", 9).alias("Predicted_prob"),
        F.lit(0.5).alias("best_threshold"),
    )
    path = writers.write_predictions(predictions, scratch_path(spark, "predictions"))
    schema = (
        "snapshot_id string, thread_id string, time timestamp_ntz, True_label int, Predicted_label int, "
        "Predicted_prob double, best_threshold double, min_recall double"
    )
    return spark.read.schema(schema).option("header", True).csv(path).drop("time")


@query("sink_metrics", """SELECT event_type AS model, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1
UNION ALL SELECT 'user ' || CAST(user_id AS VARCHAR), count(*), round(sum(value), 4) FROM events GROUP BY 1""")
def sink_metrics(spark, d):
    events = table(spark, d, "events")
    path = scratch_path(spark, "metrics")
    for name in (F.col("event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string"))):
        run = events.groupBy(name.alias("model")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        writers.append_metrics(run, path)
    return spark.read.schema("model string, n long, total double").parquet(path)


@query("runs_table", """WITH e AS (SELECT event_type AS model, CASE WHEN event_id % 2 = 0 THEN 'gpu' ELSE 'cpu' END AS device, value FROM events)
SELECT model, round(sum(value) / count(*), 6) AS latency, round(count(*) / sum(value), 6) AS throughput, round(sum(value), 4) AS duration, device FROM e GROUP BY model, device""")
def runs_table(spark, d):
    from threadsieve.operators.runs import latency_summary
    timed = table(spark, d, "events").select(
        F.col("event_type").alias("model"), F.when(F.col("event_id") % 2 == 0, "gpu").otherwise("cpu").alias("device"),
        F.col("value").alias("duration"),
    )
    summary = latency_summary(timed, ["model", "device"]).select(
        "model", F.round("latency", 6).alias("latency"), F.round("throughput", 6).alias("throughput"),
        F.round("duration", 4).alias("duration"), "device",
    )
    path = scratch_path(spark, "runs")
    summary.write.csv(f"{path}/whole")
    return readers.read_latency_runs(spark, f"{path}/whole")


@query("perplexity_runs", """SELECT CAST(user_id AS INTEGER) AS epoch, round(avg(value) FILTER (WHERE event_id % 5 <> 0), 6) AS train_perplexity,
round(avg(value) FILTER (WHERE event_id % 5 = 0), 6) AS val_perplexity FROM events GROUP BY 1""")
def perplexity_runs(spark, d):
    held = F.col("event_id") % 5 == 0
    epochs = table(spark, d, "events").groupBy(F.col("user_id").cast("int").alias("epoch")).agg(
        F.round(F.avg(F.when(~held, F.col("value"))), 6).alias("train_perplexity"),
        F.round(F.avg(F.when(held, F.col("value"))), 6).alias("val_perplexity"),
    )
    path = scratch_path(spark, "perplexity")
    epochs.write.csv(path)
    return readers.read_perplexity_runs(spark, path)


@query("lexicon_load", f"WITH {DICTIONARY} SELECT word FROM dict")
def lexicon_load(spark, d):
    words = dictionary(spark, d)
    noisy = words.select(F.explode(F.array(
        F.concat(F.lit("; about "), "word"), F.lit(""), F.concat(F.lit("  "), "word", F.lit(" "))
    )).alias("value"))
    path = scratch_path(spark, "lexicon")
    noisy.write.text(path)
    return readers.read_list(spark, path)
