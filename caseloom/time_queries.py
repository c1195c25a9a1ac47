"""Queries over the times of events and orders: as-of and interval joins, sessions, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import metrics, temporal
from caseloom.queries import query, table


@query(
    """WITH u AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error'),
    r AS (SELECT user_id, ts, event_id AS error_id, value AS error_value FROM events WHERE event_type = 'error')
    SELECT u.event_id, coalesce(r.error_id, -1) AS error_id, coalesce(r.error_value, -1.0)::DOUBLE AS error_value FROM u ASOF LEFT JOIN r ON u.user_id = r.user_id AND u.ts >= r.ts"""
)
def last_error_before(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's last error before it."""
    events = table(spark, d, "events")
    errors = events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"), F.col("value").alias("error_value"))
    others = events.where("event_type <> 'error'").select("event_id", "user_id", "ts")
    out = temporal.asof_join(others, errors, ["user_id"], "ts", ["error_id", "error_value"], order=["error_id"])
    return out.select("event_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("error_id", "error_value")])


@query(
    """SELECT e.event_id AS error_id, count(*) AS n FROM events e JOIN events x ON x.user_id = e.user_id AND x.ts >= e.ts AND x.ts < e.ts + INTERVAL 6 HOUR
    WHERE e.event_type = 'error' GROUP BY e.event_id"""
)
def events_after_errors(spark: SparkSession, d: str) -> DataFrame:
    """How many events of its user follow each error within six hours, itself included."""
    events = table(spark, d, "events")
    spans = events.where("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("end")
    )
    pairs = temporal.interval_join(spans, events.select("user_id", "ts"), ["user_id"], "start", "end", "ts")
    return pairs.groupBy("error_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, s"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.sessions(table(spark, d, "events"), ["user_id"], gap="2 hours")


@query(
    """SELECT event_type, q::DOUBLE AS q, count(*) AS n, true AS within_error
    FROM events, (VALUES (0.5), (0.95), (0.99)) t(q) WHERE value IS NOT NULL GROUP BY ALL"""
)
def window_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of each event type from sketches of hours, merged, and whether their exact ranks
    are within the sketch's error."""
    events = table(spark, d, "events").select("event_type", "ts", "value")
    merged = metrics.merged_sketches(metrics.quantile_sketches(events, by=("event_type",)), ("event_type",))
    found = metrics.sketch_quantiles(merged, by=("event_type",)).withColumnRenamed("value", "estimate")
    ranks = events.where("value is not null").join(found, "event_type").groupBy("event_type", "q").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("below"),
        F.avg((F.col("value") <= F.col("estimate")).cast("double")).alias("upto"),
    )
    room = metrics.RANK_ERROR
    return ranks.select("event_type", "q", "n", ((F.col("below") <= F.col("q") + room) & (F.col("upto") >= F.col("q") - room)).alias("within_error"))
