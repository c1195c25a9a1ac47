"""Joins and groups by time: as-of join, interval join, sessions, and late rows kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def _slice(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], order: list[str] | None = None,
    slice_seconds: int = 86_400, within: int | None = None,
) -> DataFrame:
    """left with the columns values of the last row of right with equal keys and a time not later.

    Both sides are one sequence by keys and time, cut into slices of slice_seconds, so a key with a
    large share of the rows is many tasks.  A row whose slice holds no earlier row of right takes
    the last one of the slices before, of which there is one row a slice.  Of rows of right with
    equal time the one that is last by `order` counts.  within: at most so many seconds apart.
    Rows of left with a null key or time, or without a match, get nulls; values' names must not be
    columns of left.
    """
    order = order or []
    columns = left.columns
    packed = F.struct(F.col(ts).alias("ts"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in values])
    keyed = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in [*keys, ts]))
    found = keyed(right).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).alias("_ts"), packed.alias("_found"))
    asked = left.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).alias("_ts"), F.struct(*[F.col(c) for c in columns]).alias("_row")
    )
    names = [f"_k{i}" for i in range(len(keys))]
    ready = asked.where(" and ".join(f"{c} is not null" for c in [*names, "_ts"]))
    none = F.lit(None)
    both = found.select(*names, "_ts", "_found", none.cast(asked.schema["_row"].dataType).alias("_row")).unionByName(
        ready.select(*names, "_ts", none.cast(found.schema["_found"].dataType).alias("_found"), "_row")
    ).withColumn("_slice", _slice(F.col("_ts"), slice_seconds))
    # rows of right come before those of left with the same time
    so_far = Window.partitionBy(*names, "_slice").orderBy("_ts", F.col("_row").isNotNull(), "_found").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_here", F.last("_found", ignorenulls=True).over(so_far)).where("_row is not null")
    ends = both.groupBy(*names, "_slice").agg(F.max("_found").alias("_end"))  # a row a slice
    earlier = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*names, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    out = placed.join(carried, [*names, "_slice"]).withColumn("_match", F.coalesce("_here", "_carried"))
    if within is not None:
        apart = F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("_match.ts").cast("timestamp"))
        out = out.withColumn("_match", F.when(apart <= within * 1_000_000, F.col("_match")))
    done = out.select("_row.*", *[F.col(f"_match.{v}").alias(v) for v in values])
    rest = asked.where(" or ".join(f"{c} is null" for c in [*names, "_ts"])).select(
        "_row.*", *[none.cast(right.schema[v].dataType).alias(v) for v in values]
    )
    return done.unionByName(rest)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, ts: str, slice_seconds: int = 3_600) -> DataFrame:
    """Pairs of a row of left, an interval [start, end), and a row of right with equal keys and a
    time within it.  Intervals are entered in every slice of time they touch, so an equality join
    by keys and slice finds each pair once.  Only keys may be names of columns of both."""
    last = F.greatest(F.col(start), F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    cut = left.where(F.col(start) < F.col(end)).withColumn(
        "_slice", F.explode(F.sequence(_slice(F.col(start), slice_seconds), _slice(last, slice_seconds)))
    )
    points = right.withColumn("_slice", _slice(F.col(ts), slice_seconds))
    return cut.join(points, [*keys, "_slice"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_slice")


def sessions(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(keys, start, end, n): stretches of events with no more than gap between neighbours; end is
    the last event's time.  late: the watermark, for a stream."""
    rows = events.withWatermark(ts, late) if late else events
    grouped = rows.groupBy(*keys, F.session_window(ts, gap).alias("session"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("end")).select(*keys, F.col("session.start").alias("start"), "end", "n")


def split_late(events: DataFrame, ts: str, delay_seconds: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's rows to path/on_time, and to path/late those older than the latest time of
    the batches before less the delay, the rule of a watermark.

    The latest time of each batch is kept in path/times, and a batch that is repeated after a
    failure replaces what it wrote, so a restart goes on with the same decisions.  Rows without a
    time are late.  counts() adds up both.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        limit = _latest(spark, path, number)
        is_late = F.col(ts).isNull() if limit is None else F.col(ts).isNull() | (F.col(ts) < F.lit(limit) - F.expr(f"INTERVAL {delay_seconds} SECONDS"))
        batch.where(~is_late).write.mode("overwrite").parquet(f"{path}/on_time/batch={number}")
        batch.where(is_late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(ts).alias("latest")).write.mode("overwrite").parquet(f"{path}/times/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark, path: str, number: int):
    """The latest time of the batches before; a row a batch."""
    if not number:
        return None
    return spark.read.parquet(f"{path}/times").where(F.col("batch") < number).agg(F.max("latest")).first()[0]


def counts(spark, path: str) -> DataFrame:
    """(batch, on_time, late): how many rows each batch of split_late() had."""
    read = lambda name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").groupBy("batch").count()
    on_time, late = read("on_time").withColumnRenamed("count", "on_time"), read("late").withColumnRenamed("count", "late")
    return spark.read.parquet(f"{path}/times").select("batch").join(on_time, "batch", "left").join(late, "batch", "left").fillna(0)
