"""Streams: replays add no rows, rejects never reach the model, changed threads alone are written."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadsieve.operators import rows, threads
from threadsieve.streaming import scoring

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_replayed_batch_adds_no_row_and_rejects_reach_no_model(spark, tmp_path, monkeypatch):
    seen = []

    def answers(df, model, threshold):
        seen.extend(r.request_id for r in df.select("request_id").collect())
        return df.withColumns({"prob_pred": F.lit(0.7), "predicted_label": F.lit(1), "pred_response": F.lit("x"), "pred_1": F.lit(0.7), "pred_0": F.lit(0.3)})

    monkeypatch.setattr(scoring, "score_messages", answers)
    requests = spark.createDataFrame(
        [(f"r-{i}", "12", "u1234" if i % 3 else "7", "s", "t", "g", "text" if i % 5 else None, datetime(2023, 1, 1)) for i in range(30)],
        "request_id string, caller_id string, user_id string, snapshot_id string, thread_id string, gcid string, email string, time timestamp_ntz")
    checked = rows.validate(requests, rows.request_rules())
    for batch in (4, 5, 4, 4):
        scoring.route_batch(checked, batch, None, 0.5, str(tmp_path))
    fine = {f"r-{i}" for i in range(30) if i % 3 and i % 5}
    assert set(seen) == fine
    accepted = spark.read.parquet(f"{tmp_path}/accepted").collect()
    assert len(accepted) == 2 * len(fine) and {(r.request_id, r.batch) for r in accepted} == {(f, b) for f in fine for b in (4, 5)}
    rejected = spark.read.parquet(f"{tmp_path}/rejected").where("batch = 4").collect()
    assert {r.request_id: tuple(r.reasons) for r in rejected} == {
        f"r-{i}": tuple(n for n, bad in (("user_id", i % 3 == 0), ("body", i % 5 == 0)) if bad) for i in range(30) if not (i % 3 and i % 5)}


def test_changes_out_of_order_equal_the_batch_result(spark, tmp_path):
    rng = random.Random(2)
    start = datetime(2023, 1, 1)
    data = [(i, rng.choice([None, *range(12)]), None if rng.random() < 0.1 else start + timedelta(hours=rng.randint(0, 40))) for i in range(300)]
    rng.shuffle(data)
    schema = "snapshot_id long, thread_id long, time timestamp_ntz"
    for part in range(4):
        spark.createDataFrame(data[part::4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        source = source.withColumn("message", F.col("snapshot_id"))
        scoring.write_batches(scoring.latest_changes(source, ["message"]), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    changes = spark.read.parquet(f"{tmp_path}/out")
    assert changes.select("batch").distinct().count() > 1 and changes.count() < 300
    got = {r.thread_id: r.message for r in scoring.read_latest(changes).collect()}
    want = {r.thread_id: r.snapshot_id for r in threads.latest_per_thread(spark.createDataFrame(data, schema)).collect()}
    assert got == want and len(got) == 12


def test_a_table_of_parts_is_streamed_like_one_file(spark, tmp_path):
    from registry import streams

    table = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(30)], streams.TABLES["documents"])
    table.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    table.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    for kind in ("parts", "one"):
        found = spark.read.parquet(streams.finish(spark, streams.stream(spark, str(tmp_path / kind), "documents"), kind))
        assert sorted(r.doc_id for r in found.collect()) == list(range(30))
