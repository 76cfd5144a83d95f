"""Declared schemas; nothing is inferred at read time."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("gcid", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("is_complaint", T.StringType()),
    T.StructField("is_feedback", T.StringType()),
    T.StructField("supervised_groups", T.StringType()),
])

PREDICTION = T.StructType([
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("gcid", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("True_label", T.IntegerType()),
    T.StructField("Predicted_label", T.IntegerType()),
    T.StructField("Predicted_prob", T.DoubleType()),
    T.StructField("best_threshold", T.DoubleType()),
])

SCORING_REQUEST = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("gcid", T.StringType()),
    T.StructField("time", T.LongType()),
])

LATENCY_RUN = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("throughput", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("device", T.StringType()),
])

PERPLEXITY_RUN = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("train_perplexity", T.DoubleType()),
    T.StructField("val_perplexity", T.DoubleType()),
])

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
