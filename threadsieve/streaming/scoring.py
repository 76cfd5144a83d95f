"""Structured Streaming: scoring with rejects, daily errors, deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from threadsieve.functions.keys import time_levels_desc
from threadsieve.operators import rows
from threadsieve.operators.evaluation import counts_above
from threadsieve.plans.training import score_messages
from threadsieve.schemas import SCORING_REQUEST

LATE = "2 days"


def parse_requests(df: DataFrame, body: str = "value") -> DataFrame:
    """JSON bodies with header columns become typed columns; the epoch time
    becomes a timestamp. A body that does not parse gives null fields."""
    parsed = df.withColumn("_r", F.from_json(body, SCORING_REQUEST))
    fields = [F.col(f"_r.{f.name}").alias(f.name) for f in SCORING_REQUEST.fields if f.name != "time"]
    time = F.timestamp_seconds(F.col("_r.time")).cast("timestamp_ntz").alias("time")
    return parsed.select(*[c for c in df.columns if c != body], *fields, time)


def score_requests(
    requests: DataFrame, model: PipelineModel, threshold: float | None, rules: dict[str, Column] | None = None
) -> DataFrame:
    """Accepted requests with their score and response, rejected ones with reasons."""
    checked = rows.validate(requests, rules or rows.request_rules())
    accepted = F.size("reasons") == 0
    scored = score_messages(checked, model, threshold)
    out = scored.withColumn("status", F.when(accepted, "accepted").otherwise("rejected"))
    answers = ["prob_pred", "predicted_label", "pred_response", "pred_1", "pred_0"]
    return out.withColumns({c: F.when(accepted, F.col(c)) for c in answers})


def response_json(df: DataFrame) -> Column:
    return F.to_json(F.struct("snapshot_id", "status", "reasons", "pred_response", "pred_1", "pred_0"))


def _event_time(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need a zoned timestamp; sessions run in UTC, so days agree."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def daily_error_counts(
    scored: DataFrame, predicted: Column, time: str = "time", target: str = "target", late: str = LATE, by: tuple[str, ...] = ()
) -> DataFrame:
    """Counts per day and value of ``by``.

    Written in append mode, a day appears once it is final: rows later than ``late`` behind the newest are dropped.
    Written by ``write_report``, every day is there at once and late rows count; the state is one row per day and group.
    """
    named = counts_above(F.col(target), predicted)
    return (
        _event_time(scored, time).withWatermark(time, late)
        .groupBy(F.window(time, "1 day").alias("w"), *by)
        .agg(*[c.alias(n) for n, c in named.items()])
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *by, *named)
    )


def drop_repeats(df: DataFrame, keys: list[str], time: str = "time", late: str = LATE) -> DataFrame:
    """The first delivery of each message; state is kept for the watermark only."""
    return _event_time(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def latest_per_thread(
    df: DataFrame, columns: list[str], key: str = "thread_id", time: str = "time", row_id: str = "snapshot_id"
) -> DataFrame:
    """Running newest message of each thread (update or complete mode): one state
    row per thread."""
    order = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(time_levels_desc(F.col(time)))], F.col(row_id).alias("_id"))
    newest = F.min_by(F.struct(*columns), order)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("_m")).select(key, "_m.*")


class _Newest(StatefulProcessor):
    """Keeps the order and the columns of a key's newest row; a row that is newer replaces them and is emitted."""

    def __init__(self, key: str, columns: list[str], time: str, row_id: str, schema: StructType, ttl_ms: int):
        self.key, self.columns, self.time, self.row_id, self.schema, self.ttl_ms = key, columns, time, row_id, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.schema, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, changed = (tuple(self.newest.get()) if self.newest.exists() else None), False
        for row in rows:
            # the newest time first, null times last; equal times go to the lowest id
            time = row[self.time]
            order = (time is not None, time if time is not None else datetime.min)
            old = best and (best[0] is not None, best[0] if best[0] is not None else datetime.min)
            if best is None or order > old or (order == old and row[self.row_id] < best[1]):
                best, changed = (time, row[self.row_id], *[row[c] for c in self.columns]), True
        if changed:
            self.newest.update(best)
            yield Row(**{self.key: key[0], **dict(zip(("_time", "_id", *self.columns), best))})

    def close(self) -> None:
        pass


def latest_changes(
    df: DataFrame, columns: list[str], key: str = "thread_id", time: str = "time", row_id: str = "snapshot_id", ttl: timedelta = timedelta(days=30),
) -> DataFrame:
    """Threads whose newest message has changed (update mode), with ``_time`` and ``_id`` of that message.

    State is one row per thread that had a change within ``ttl`` of processing time, held by RocksDB
    (``spark.sql.streaming.stateStore.providerClass``); a thread that comes back later is emitted anew. Rows without a thread are
    dropped. What is written may hold a thread several times: ``read_latest`` takes the newest.
    """
    fields = df.schema
    state = StructType([StructField("_time", fields[time].dataType), StructField("_id", fields[row_id].dataType),
                        *[StructField(c, fields[c].dataType) for c in columns]])
    out = StructType([StructField(key, fields[key].dataType), *state.fields])
    newest = _Newest(key, columns, time, row_id, state, int(ttl.total_seconds() * 1000))
    return df.where(F.col(key).isNotNull()).groupBy(key).transformWithState(newest, out, "update", "processingTime")


def read_latest(changes: DataFrame, key: str = "thread_id") -> DataFrame:
    """The newest message of each thread from what ``latest_changes`` has written, the changes in any order."""
    order = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(time_levels_desc(F.col("_time")))], F.col("_id").alias("_i"))
    columns = [c for c in changes.columns if c not in (key, "_time", "_id", "batch")]
    return changes.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_m")).select(key, "_m.*")


def write_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch in a folder of its own number, which a replay of the batch replaces.

    State with a time to live asks for another batch for ever, so that a run over what is available would not end; batches
    without data are switched off for it.
    """
    conf, name = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")
    try:
        return _start_batches(df, path, checkpoint)
    finally:
        conf.set(name, before)


def _start_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start()
    )


def route_batch(
    checked: DataFrame, batch: int, model: PipelineModel, threshold: float | None, path: str,
) -> None:
    """Answer one batch of validated requests: accepted ones are scored, rejected ones only told why.

    The batch is read once and written to ``accepted`` and ``rejected`` under its own number, so a replay adds no row.
    """
    checked = checked.persist(StorageLevel.DISK_ONLY)
    try:
        fine = F.size("reasons") == 0
        names = ["request_id", "status", "reasons", "response"]
        scored = score_messages(checked.where(fine), model, threshold).withColumn("status", F.lit("accepted"))
        scored.withColumn("response", response_json(scored)).select(*names, "prob_pred", "predicted_label").write.mode("overwrite").parquet(
            f"{path}/accepted/batch={batch}")
        refused = checked.where(~fine).withColumns({
            "status": F.lit("rejected"), "pred_response": F.lit(None).cast("string"),
            "pred_1": F.lit(None).cast("double"), "pred_0": F.lit(None).cast("double")})
        refused.withColumn("response", response_json(refused)).select(*names).write.mode("overwrite").parquet(f"{path}/rejected/batch={batch}")
    finally:
        checked.unpersist()


def route_requests(
    requests: DataFrame, model: PipelineModel, threshold: float | None, path: str, checkpoint: str, rules: dict[str, Column] | None = None,
) -> StreamingQuery:
    """Validate a stream of requests and answer it batch by batch, everything that is available now."""
    checked = rows.validate(requests, rules or rows.request_rules())
    return (
        checked.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda part, batch: route_batch(part, batch, model, threshold, path)).start()
    )


def write_stream(df: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Append to Parquet, exactly once, everything that is available now."""
    writer = (
        df.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).option("path", path)
    )
    return (writer.partitionBy(partition) if partition else writer).start()


def write_report(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole of a report-sized result, written again after each batch, over everything that is available now."""
    return (
        df.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, epoch: rows.write.mode("overwrite").parquet(path)).start()
    )
