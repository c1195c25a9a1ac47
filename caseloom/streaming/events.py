"""Streaming forms: event dedup, windowed alerts, circuit breakers, incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def dedup_events(events: DataFrame, key: str = "event_key", ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; state is bounded by time."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def window_rates(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n, mean value) over sliding event-time windows."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width, slide), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    )


def request_counts(events: DataFrame, width: str = "1 minute", late: str = "5 minutes", limit: int = 30) -> DataFrame:
    """(window, client, n, limited): requests of each client in tumbling windows."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "client").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("limited", F.col("n") > limit)


# --- circuit breaker ---------------------------------------------------------------------

FAILURES, RECOVERY_SECONDS, PROBES, SUCCESSES = 5, 60.0, 2, 2


def breaker_step(state: tuple, at: float, ok: bool) -> tuple[tuple, str, bool]:
    """(new state, its name, whether the call was let through).

    state: (name, failures, opened at, probes, successes).  Five failures open the breaker; a
    success takes one failure back; after 60 seconds two probes are let through, and two
    successes close it again, a failure opens it.
    """
    name, failures, opened, probes, successes = state
    if name == "open" and at - opened >= RECOVERY_SECONDS:
        name, probes, successes = "half_open", 0, 0
    if name == "open" or (name == "half_open" and probes >= PROBES):
        return (name, failures, opened, probes, successes), name, False
    if name == "half_open":
        probes += 1
        if not ok:
            return ("open", failures + 1, at, 0, 0), "open", True
        successes += 1
        if successes >= SUCCESSES:
            return ("closed", 0, 0.0, 0, 0), "closed", True
        return (name, failures, opened, probes, successes), name, True
    failures = max(0, failures - 1) if ok else failures + 1
    if failures >= FAILURES:
        return ("open", failures, at, 0, 0), "open", True
    return ("closed", failures, 0.0, 0, 0), "closed", True


CLOSED = ("closed", 0, 0.0, 0, 0)
BREAKER_OUT = "upstream string, ts timestamp, ok boolean, state string, allowed boolean"
BREAKER_STATE = "name string, failures int, opened double, probes int, successes int"


def breaker_stream(calls: DataFrame) -> DataFrame:
    """Breaker state after each call of a stream (upstream, ts, ok), per upstream."""

    def run(key, batches: Iterator[pd.DataFrame], state):
        now = tuple(state.get) if state.exists else CLOSED
        rows = []
        for pdf in batches:
            for r in pdf.sort_values("ts").itertuples():
                now, name, allowed = breaker_step(now, r.ts.timestamp(), bool(r.ok))
                rows.append((key[0], r.ts, bool(r.ok), name, allowed))
        state.update(now)
        yield pd.DataFrame(rows, columns=["upstream", "ts", "ok", "state", "allowed"])

    return calls.groupBy("upstream").applyInPandasWithState(run, BREAKER_OUT, BREAKER_STATE, "append", "NoTimeout")


def breaker_batch(calls: DataFrame) -> DataFrame:
    """The same for a table: one fold for each upstream over its calls in order.

    Calls are sorted by Spark and come to the fold in batches, so a task holds a batch of them and
    one state, however many calls an upstream has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upstream, now = None, CLOSED
        for batch in batches:
            names, states, allowed = batch.column(0).to_pylist(), [], []
            for name, at, ok in zip(names, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if name != upstream:
                    upstream, now = name, CLOSED
                now, state, let = breaker_step(now, at / 1e6, ok)
                states.append(state)
                allowed.append(let)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(states, pa.string()), pa.array(allowed, pa.bool_())], ["upstream", "seq", "state", "allowed"]
            )

    rows = calls.select(
        F.col("upstream").cast("string"), F.col("seq").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("ok").cast("boolean")
    )
    ordered = rows.repartition("upstream").sortWithinPartitions("upstream", F.asc_nulls_last("at"), F.asc_nulls_last("seq"))
    return ordered.mapInArrow(run, "upstream string, seq long, state string, allowed boolean")


def ingest_stream(spark: SparkSession, folder: str, schema, transform, sink: str, checkpoint: str) -> StreamingQuery:
    """New files of a folder, each once, through transform into a Parquet sink."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return (
        transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def export_metrics(spark: SparkSession, events: DataFrame, write, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Calls write(batch, number) for each trigger."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def new_sources(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose source is not stored yet."""
    return files.join(stored.select("source").distinct(), "source", "left_anti")
