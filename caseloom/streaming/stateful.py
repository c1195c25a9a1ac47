"""Stateful streams on transformWithState: circuit breakers and buffers of the last observations.

Both keep a bounded state for each key: a breaker five numbers, a buffer its last values.  State
lives in RocksDB, is part of the stream's checkpoint, may start from a table, and of keys that are
heard of no more it goes after a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caseloom.streaming.events import BREAKER_STATE, CLOSED, RECOVERY_SECONDS, breaker_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_MS = 24 * 3600 * 1000


def use_state_store(spark: SparkSession) -> None:
    """The state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Breaker(StatefulProcessor):
    """Opens after failures, by the rules of events.breaker_step(); a timer marks the moment at
    which an open breaker lets probes through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("breaker", BREAKER_STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        self._keep((r["state"], int(r["failures"]), float(r["opened"]), int(r["probes"]), int(r["successes"])), None)

    def _now(self) -> tuple:
        return tuple(self._state.get()) if self._state.exists() else CLOSED

    def _keep(self, now: tuple, before: tuple | None) -> None:
        """Keep a state; an open breaker has one timer, at the end of its rest."""
        self._state.update(now)
        for due in list(self._handle.listTimers()) if before is not None and before[0] == "open" else []:
            self._handle.deleteTimer(due if isinstance(due, int) else due[0])
        if now[0] == "open":
            self._handle.registerTimer(int((now[2] + RECOVERY_SECONDS) * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        first = now = self._now()
        states, allowed = [], []
        for at, ok in zip(calls["ts"].map(pd.Timestamp.timestamp), calls["ok"].astype(bool), strict=True):
            now, name, let = breaker_step(now, at, ok)
            states.append(name)
            allowed.append(let)
        if now != first:
            self._keep(now, first)
        yield pd.DataFrame({"upstream": key[0], "seq": calls["seq"].astype("Int64"), "ts": calls["ts"], "state": states, "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        now = self._now()
        if now[0] == "open" and (now[2] + RECOVERY_SECONDS) * 1000 <= due + 1:
            self._state.update(("half_open", now[1], now[2], 0, 0))
            yield pd.DataFrame({
                "upstream": [key[0]], "seq": pd.array([None], dtype="Int64"), "ts": [pd.Timestamp(due, unit="ms")], "state": ["half_open"],
                "allowed": [None],
            })

    def close(self) -> None:
        pass


BREAKER_OUT = "upstream string, seq long, ts timestamp, state string, allowed boolean"


def breaker_states(calls: DataFrame, late: str = "10 seconds", initial: DataFrame | None = None) -> DataFrame:
    """A row for each call of a stream (upstream, seq, ts, ok): the breaker's state after it and
    whether it was let through; and a row without seq when an open breaker starts to recover.

    Calls of one upstream come in order of time but for `late`.  initial: (upstream, state,
    failures, opened, probes, successes), states to start with.
    """
    use_state_store(calls.sparkSession)
    watched = calls.select("upstream", F.col("seq").cast("long").alias("seq"), "ts", "ok").withWatermark("ts", late)
    start = {"initialState": initial.groupBy("upstream")} if initial is not None else {}
    return watched.groupBy("upstream").transformWithStateInPandas(Breaker(), BREAKER_OUT, "Append", "EventTime", **start)


class Buffer(StatefulProcessor):
    """The last `most` values of a key; those older than the time to live go by themselves."""

    def __init__(self, most: int, keep_ms: int) -> None:
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._values = handle.getListState("values", "value double", self.keep_ms)
        self._seen = handle.getValueState("seen", "n long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")["value"].dropna()
        held = [v[0] for v in self._values.get()] if self._values.exists() else []
        seen = (self._seen.get()[0] if self._seen.exists() else 0) + len(new)
        kept = (held + new.tolist())[-self.most :]
        if kept:
            self._values.put([(float(v),) for v in kept])
        self._seen.update((seen,))
        x = pd.Series(kept, dtype=float).sort_values()
        at = lambda q: float(x.iloc[min(len(x) - 1, int(len(x) * q))]) if len(x) else None
        yield pd.DataFrame({"metric": [key[0]], "seen": [seen], "held": [len(kept)], "mean": [float(x.mean()) if len(x) else None], "p50": [at(0.5)], "p95": [at(0.95)], "p99": [at(0.99)]})

    def close(self) -> None:
        pass


def last_values(observations: DataFrame, most: int = 1000, keep_ms: int = KEEP_MS) -> DataFrame:
    """For each batch of a stream (metric, seq, ts, value), each metric's summary of its last `most`
    values: (metric, seen, held, mean, p50, p95, p99)."""
    use_state_store(observations.sparkSession)
    rows = observations.select("metric", F.col("seq").cast("long").alias("seq"), "ts", F.col("value").cast("double").alias("value"))
    return rows.groupBy("metric").transformWithStateInPandas(
        Buffer(most, keep_ms), "metric string, seen long, held long, mean double, p50 double, p95 double, p99 double", "Update", "ProcessingTime"
    )
