from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from caseloom.streaming import events, stateful

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def calls():
    rng = random.Random(2)
    rows, at = [], {"a": 0.0, "b": 0.0, "c": 0.0}
    for seq in range(900):
        up = rng.choice("abc")
        at[up] = max(at.values()) + rng.choice([0.5, 1.0, 3.0, 20.0 if up == "b" else 2.0])
        rows.append((up, seq, T0 + timedelta(seconds=at[up]), rng.random() < {"a": 0.9, "b": 0.3, "c": 0.5}[up]))
    return rows


SCHEMA = "upstream string, seq long, ts timestamp, ok boolean"


def fold(rows, start=None):
    now, out = dict(start or {}), {}
    for up, seq, ts, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        now[up], name, allowed = events.breaker_step(now.get(up, events.CLOSED), ts.timestamp(), ok)
        out[seq] = (name, allowed)
    return out


def stream(spark, folder, schema, make, mode, tmp, per=1):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(f"file://{folder}")
    out = make(rows).writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp}/check")
    got = []
    q = out.foreachBatch(lambda df, n: got.append(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return [r for batch in got for r in batch]


def write(spark, rows, schema, folder, first, parts):
    size = -(-len(rows) // parts)
    for k in range(parts):
        path = folder / f"{first + k:03d}"
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(f"file://{path}.tmp")
        for f in (folder / f"{first + k:03d}.tmp").glob("*.parquet"):
            f.rename(folder / f"{first + k:03d}.parquet")


def test_breakers_equal_the_fold_over_restarts(spark, calls, tmp_path):
    """Two runs on one checkpoint give each call's state as one fold over all calls."""
    folder = tmp_path / "in"
    folder.mkdir()
    write(spark, calls[:500], SCHEMA, folder, 0, 3)
    first = stream(spark, folder, SCHEMA, stateful.breaker_states, "append", tmp_path)
    write(spark, calls[500:], SCHEMA, folder, 10, 2)
    second = stream(spark, folder, SCHEMA, stateful.breaker_states, "append", tmp_path)
    got = {r["seq"]: (r["state"], r["allowed"]) for r in first + second if r["seq"] is not None}
    want = fold(calls)
    assert got == want and len({s for s, _ in want.values()}) == 3


def test_a_timer_tells_of_the_recovery(spark, tmp_path):
    """An upstream that nobody calls recovers when the stream's time has passed, once."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("x", k, T0 + timedelta(seconds=k), False) for k in range(5)] + [("y", 10 + k, T0 + timedelta(seconds=5 * k), True) for k in range(60)]
    write(spark, sorted(rows, key=lambda r: r[2]), SCHEMA, folder, 0, 6)
    got = stream(spark, folder, SCHEMA, stateful.breaker_states, "append", tmp_path)
    told = [(r["upstream"], r["state"], r["allowed"], r["ts"]) for r in got if r["seq"] is None]
    assert [t[:3] for t in told] == [("x", "half_open", None)]
    write(spark, [("x", 100, T0 + timedelta(seconds=400), True), ("x", 101, T0 + timedelta(seconds=401), True)], SCHEMA, folder, 10, 1)
    later = stream(spark, folder, SCHEMA, stateful.breaker_states, "append", tmp_path)
    assert [(r["seq"], r["state"], r["allowed"]) for r in later] == [(100, "half_open", True), (101, "closed", True)]


def test_breakers_start_from_a_table(spark, calls, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    opened = T0.timestamp() - 10
    start = {"a": ("open", 5, opened, 0, 0), "c": ("closed", 4, 0.0, 0, 0)}
    initial = spark.createDataFrame([(k, *v) for k, v in start.items()], "upstream string, state string, failures int, opened double, probes int, successes int")
    write(spark, calls[:200], SCHEMA, folder, 0, 1)
    rows = stream(spark, folder, SCHEMA, lambda c: stateful.breaker_states(c, initial=initial), "append", tmp_path)
    assert {r["seq"]: (r["state"], r["allowed"]) for r in rows if r["seq"] is not None} == fold(calls[:200], start)


def test_buffers_hold_the_last_values(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(8)
    schema = "metric string, seq long, ts timestamp, value double"
    rows = [(rng.choice(["x", "x", "y"]), i, T0 + timedelta(seconds=i), None if i % 97 == 0 else rng.random()) for i in range(700)]
    write(spark, rows, schema, folder, 0, 4)
    got = stream(spark, folder, schema, lambda r: stateful.last_values(r, most=100), "update", tmp_path)
    for metric in ("x", "y"):
        values = [v for m, _, _, v in rows if m == metric and v is not None]
        last = max((r for r in got if r["metric"] == metric), key=lambda r: r["seen"])
        kept = sorted(values[-100:])
        assert (last["seen"], last["held"]) == (len(values), 100)
        assert last["mean"] == pytest.approx(sum(kept) / 100) and (last["p50"], last["p95"]) == (kept[50], kept[95])
    assert all(r["held"] <= 100 for r in got)


def test_batch_breakers_stream_each_upstream(spark, calls):
    """A table gives the fold too, over many batches of an upstream; no task gets one whole."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = events.breaker_batch(spark.createDataFrame(calls, SCHEMA).repartition(5))
        assert {r["seq"]: (r["state"], r["allowed"]) for r in got.collect()} == fold(calls)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
