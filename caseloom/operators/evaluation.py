"""Retrieval and answer metrics over arrays, and the report over all questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def precision_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Relevant ones among the first k, repeats counted, over k; 0 for k = 0."""
    hits = F.size(F.filter(F.slice(retrieved, 1, max(k, 1)), lambda r: F.array_contains(relevant, r)))
    return F.coalesce(hits / F.lit(float(k)), F.lit(0.0)) if k > 0 else F.lit(0.0)


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant list that is among the first k; 0 without relevant ones."""
    first = F.slice(retrieved, 1, max(k, 1))
    hits = F.size(F.filter(relevant, lambda r: F.array_contains(first, r)))
    return F.when((F.size(relevant) > 0) & F.lit(k > 0), hits / F.size(relevant)).otherwise(F.lit(0.0))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    ranks = F.filter(
        F.transform(retrieved, lambda r, i: F.when(F.array_contains(relevant, r), i + 1)), lambda x: x.isNotNull()
    )
    return F.when(F.size(ranks) > 0, F.lit(1.0) / F.try_element_at(ranks, F.lit(1))).otherwise(F.lit(0.0))


def rank_metrics(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(key, precision_at_k, recall_at_k, reciprocal_rank) of retrieved(key, item, rank), ranks from 1,
    against relevant(key, item), for each key of retrieved: the same as the functions above on
    lists, by joins, for keys with any number of items.  Repeated items of relevant count once."""
    good = relevant.select("key", "item").distinct()
    hits = retrieved.join(good, ["key", "item"], "left_semi").groupBy("key").agg(
        F.sum((F.col("rank") <= k).cast("long")).alias("first"), F.min("rank").alias("best"),
        F.count_distinct(F.when(F.col("rank") <= k, F.col("item"))).alias("found"),
    )
    wanted = good.groupBy("key").agg(F.count(F.lit(1)).alias("wanted"))
    rows = retrieved.select("key").distinct().join(hits, "key", "left").join(wanted, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "key", zero(F.col("first") / F.lit(float(k))).alias("precision_at_k"), zero(F.col("found") / F.col("wanted")).alias("recall_at_k"),
        zero(F.lit(1.0) / F.col("best")).alias("reciprocal_rank"),
    )


def stem(source: Column) -> Column:
    """Base name without its extension, in lower case: gold sources carry no extension."""
    return F.lower(F.regexp_replace(F.regexp_extract(source, r"([^/\\]*)$", 1), r"\.[A-Za-z0-9]+$", ""))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    found = F.size(F.filter(keywords, lambda k: F.lower(answer).contains(F.lower(k))))
    return F.when(F.size(keywords) > 0, found / F.size(keywords))


def citation_precision(cited: Column, retrieved: Column) -> Column:
    hits = F.size(F.filter(cited, lambda c: F.exists(retrieved, lambda r: r.contains(c))))
    return F.when(F.size(cited) > 0, hits / F.size(cited)).otherwise(F.lit(0.0))


def node_timings(steps: DataFrame) -> DataFrame:
    """(run_id, node, seconds): time since the step before in the run; null for the first."""
    order = Window.partitionBy("run_id").orderBy("ts", "step_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return steps.select("run_id", "step_id", "node", ((micros - F.lag(micros).over(order)) / 1e6).alias("seconds"))


def report(results: DataFrame) -> DataFrame:
    """One row of means: retrieval means over questions with relevant sources only."""
    truth = F.size("relevant") > 0
    return results.agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum(F.when(truth, 1).otherwise(0)).alias("with_truth"),
        F.round(F.avg(F.when(truth, F.col("precision_at_k"))), 6).alias("avg_precision_at_k"),
        F.round(F.avg(F.when(truth, F.col("recall_at_k"))), 6).alias("avg_recall_at_k"),
        F.round(F.avg(F.when(truth, F.col("reciprocal_rank"))), 6).alias("avg_mrr"),
    )


def metadata_coverage(docs: Column) -> Column:
    """Share of documents (struct with email_from, email_subject, message_id) with any of these."""
    has = lambda d: (
        F.coalesce(F.nullif(d["email_from"], F.lit("")), F.nullif(d["email_subject"], F.lit("")), F.nullif(d["message_id"], F.lit(""))).isNotNull()
    )
    return F.when(F.size(docs) > 0, F.size(F.filter(docs, has)) / F.size(docs)).otherwise(F.lit(0.0))


def full_report(results: DataFrame) -> DataFrame:
    """One row over all questions: means of quality, retrieval, latency and e-mail metrics, rates of
    accepted and rewritten questions, sums of warnings and stitched chunks.

    results(faithfulness, relevance, relevant, precision_at_k, recall_at_k, reciprocal_rank, seconds,
    answer_length, grade, loops, citation_precision, unsupported_rate, warnings, stitched, coverage).
    """
    truth = F.size("relevant") > 0
    mean = lambda c, n: F.round(F.avg(c), n)
    return results.agg(
        F.count(F.lit(1)).alias("questions"),
        F.coalesce(F.sum(truth.cast("long")), F.lit(0)).alias("with_truth"),
        *[mean(F.col(c), 3).alias(f"avg_{c}") for c in ("faithfulness", "relevance", "citation_precision", "unsupported_rate", "coverage")],
        *[mean(F.when(truth, F.col(c)), 3).alias(f"avg_{c}") for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")],
        mean("seconds", 2).alias("avg_seconds"),
        mean("answer_length", 0).alias("avg_answer_length"),
        mean((F.col("grade") == "yes").cast("double"), 3).alias("grader_pass_rate"),
        mean((F.col("loops") > 0).cast("double"), 3).alias("rewrite_rate"),
        F.sum("warnings").cast("long").alias("total_warnings"),
        F.sum("stitched").cast("long").alias("total_stitched"),
    )


def node_means(timings: DataFrame) -> DataFrame:
    """(node, mean_seconds) over node_timings()."""
    return timings.groupBy("node").agg(F.round(F.avg("seconds"), 4).alias("mean_seconds"))
