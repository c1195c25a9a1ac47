"""Histograms, service levels, cost, and text exposition of metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions.text import sanitise_metric


@dataclass(frozen=True)
class Thresholds:
    p95_latency: float = 30.0
    p99_latency: float = 45.0
    p95_node: float = 10.0
    error_rate: float = 0.02
    timeout_rate: float = 0.01
    cost_per_query: float = 0.15
    faithfulness: float = 0.70
    relevance: float = 0.75
    recall: float = 0.60
    mrr: float = 0.50


def percentile(sorted_values: Column, p: float) -> Column:
    """Value at index min(int(p * n), n - 1) of a sorted array."""
    n = F.size(sorted_values)
    return F.try_element_at(sorted_values, F.least(F.floor(n * F.lit(p)), n - 1).cast("int") + 1)


def last_observations(obs: DataFrame, keep: int = 1000) -> DataFrame:
    """The last `keep` rows of each name by seq."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))
    return obs.withColumn("_n", rank).where(F.col("_n") <= keep).drop("_n")


def histogram_summary(obs: DataFrame, keep: int = 1000) -> DataFrame:
    """(name, n, mean, p50, p95, p99, max) of the last `keep` observations (name, seq, value):
    an array per name is bounded by keep."""
    sample = last_observations(obs, keep).groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return sample.select(
        "name",
        F.size("v").cast("long").alias("n"),
        F.round(mean, 6).alias("mean"),
        F.round(F.try_element_at("v", F.floor(F.size("v") * F.lit(0.5)).cast("int") + 1), 6).alias("p50"),
        F.round(percentile(F.col("v"), 0.95), 6).alias("p95"),
        F.round(percentile(F.col("v"), 0.99), 6).alias("p99"),
        F.round(F.array_max("v"), 6).alias("max"),
    )


# --- mergeable quantile summaries ---------------------------------------------------------

#: Size of a sketch, and the error of a rank, as a share of all, that it keeps with 99 % confidence.
SKETCH_K, RANK_ERROR = 400, 0.0085


def quantile_sketches(obs: DataFrame, width: str = "1 hour", by: tuple[str, ...] = ("name",), late: str | None = None) -> DataFrame:
    """(by, window, n, sketch): a KLL sketch of the values of each window of obs(by, ts, value).

    Sketches are some kilobytes however many values they stand for, are made within tasks before
    anything moves, and may be merged in any order, over windows, tasks and streams.  late: the
    watermark, for a stream.
    """
    rows = obs.withWatermark("ts", late) if late else obs
    return rows.where("value is not null").groupBy(*by, F.window("ts", width).alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("value").cast("double"), SKETCH_K).alias("sketch")
    )


def merged_sketches(sketches: DataFrame, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """(by, n, sketch): the sketches of each group merged into one."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, qs: tuple[float, ...] = (0.5, 0.95, 0.99), by: tuple[str, ...] = ("name",)) -> DataFrame:
    """(by, n, q, value): values whose rank is q but for about RANK_ERROR."""
    at = lambda q: F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value"))
    return sketches.select(*by, "n", F.inline(F.array(*[at(q) for q in qs])))


def _violation(metric: Column, threshold: float, actual: Column, broken: Column) -> Column:
    return F.when(
        broken, F.struct(metric.alias("metric"), F.lit(threshold).alias("threshold"), actual.cast("double").alias("actual"))
    )


def latency_violations(summary: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(metric, threshold, actual) of histograms over their limits."""
    route = F.col("name").contains("http_request_seconds") & F.col("name").contains("query")
    node = F.col("name").contains("node_latency")
    found = F.array_compact(
        F.array(
            _violation(F.concat("name", F.lit(".p95")), t.p95_latency, F.col("p95"), route & (F.col("p95") > t.p95_latency)),
            _violation(F.concat("name", F.lit(".p99")), t.p99_latency, F.col("p99"), route & (F.col("p99") > t.p99_latency)),
            _violation(F.concat("name", F.lit(".p95")), t.p95_node, F.col("p95"), node & (F.col("p95") > t.p95_node)),
        )
    )
    return summary.select(F.explode(found).alias("v")).select("v.*")


def rate_violations(counters: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(metric, threshold, actual) of error and timeout rates over counters (name, value)."""
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("value"))), F.lit(0))
    name = F.col("name")
    sums = counters.agg(
        part(name.contains("node_invocations.retriever")).alias("total"),
        part(name.contains("llm_call_failure") | name.contains("db_call_failure")).alias("errors"),
        part(F.lower(name).contains("timeout")).alias("timeouts"),
    ).where("total > 0")
    found = F.array_compact(
        F.array(
            *[
                _violation(F.lit(m), limit, F.col(c) / F.col("total"), F.col(c) / F.col("total") > limit)
                for m, c, limit in (("error_rate", "errors", t.error_rate), ("timeout_rate", "timeouts", t.timeout_rate))
            ]
        )
    )
    return sums.select(F.explode(found).alias("v")).select("v.*")


def cost_violations(costs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Mean cost of a query (cost) over its limit."""
    mean = costs.agg(F.avg("cost").alias("c")).where(F.col("c") > t.cost_per_query)
    return mean.select(F.lit("cost_per_query").alias("metric"), F.lit(t.cost_per_query).alias("threshold"), F.col("c").alias("actual"))


def quality_violations(report: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Means of an evaluation report below their limits; missing ones are skipped."""
    limits = {
        "avg_faithfulness": t.faithfulness, "avg_relevance": t.relevance, "avg_recall_at_k": t.recall, "avg_mrr": t.mrr,
    }
    found = [
        _violation(F.lit(m), limit, F.col(m), F.col(m) < limit) for m, limit in limits.items() if m in report.columns
    ]
    return report.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.*")


def exposition(counters: DataFrame, summary: DataFrame) -> DataFrame:
    """(kind, name, seq, line): the lines of the text exposition format, to be sorted by these."""
    n = F.col("name")
    p = sanitise_metric(n)
    txt = lambda *x: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    c = counters.select(
        F.lit(0).alias("kind"), "name",
        F.posexplode(
            F.array(
                txt("# HELP ", p, " Counter: ", n), txt("# TYPE ", p, " counter"), txt(p, " ", F.col("value").cast("string"))
            )
        ).alias("seq", "line"),
    )
    quantile = lambda q, v: txt(p, '{quantile="', q, '"} ', F.col(v).cast("string"))
    s = summary.where("n > 0").select(
        F.lit(1).alias("kind"), "name",
        F.posexplode(
            F.array(
                txt("# HELP ", p, " Histogram: ", n), txt("# TYPE ", p, " summary"),
                quantile("0.5", "p50"), quantile("0.95", "p95"), quantile("0.99", "p99"),
                txt(p, "_count ", F.col("n").cast("string")),
                txt(p, "_sum ", (F.col("mean") * F.col("n")).cast("string")),
            )
        ).alias("seq", "line"),
    )
    return c.unionByName(s)


def sliding_alert(events: DataFrame, metric: Column, limit: float, width: str = "5 minutes", slide: str = "1 minute", for_windows: int = 3) -> DataFrame:
    """(window_start, value, firing): metric over sliding windows; firing when it has been over
    the limit in the last for_windows windows, one slide apart.  A window without events is not
    over the limit."""
    agg = events.groupBy(F.window("ts", width, slide).alias("w")).agg(metric.alias("value"))
    rows = agg.select(F.col("w.start").alias("window_start"), "value")
    # each window over the limit counts for itself and for those that follow: no order is needed
    step = F.expr(f"INTERVAL {slide}")
    later = F.explode(F.array(*[F.col("window_start") + step * k for k in range(for_windows)]))
    over = rows.where(F.col("value") > limit).select(later.alias("window_start")).groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(over, "window_start", "left").select(
        "window_start", "value", (F.coalesce("n", F.lit(0)) == for_windows).alias("firing")
    )
