"""JSON-lines, archive and table sources, and the sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schema as S


def read_evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected_sources, keywords, expected_answer); malformed lines are left out."""
    rows = spark.read.schema(S.EVALUATION_SET).option("mode", "DROPMALFORMED").json(path)
    empty = F.array().cast("array<string>")
    return rows.where("query is not null").select(
        "query",
        F.coalesce("expected_sources", empty).alias("expected_sources"),
        F.coalesce("expected_answer_keywords", "expected_answer_contains", empty).alias("keywords"),
        F.coalesce("expected_answer", F.lit("")).alias("expected_answer"),
    )


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(S.AUDIT_EVENT).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("ts", F.try_to_timestamp("timestamp"))


def read_archive(spark: SparkSession, path: str, preview: int = 120) -> DataFrame:
    """Saved chats, newest file first; files that are not JSON are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return (
        rows.withColumn("modified", F.col("_metadata.file_modification_time"))
        .withColumn("preview", F.substring(F.coalesce("answer", F.lit("")), 1, preview))
        .orderBy(F.desc("modified"))
    )


def read_load_stats(spark: SparkSession, path: str) -> DataFrame:
    """(name, requests, failures, mean, p95, p99) in seconds; missing percentiles are estimated
    as 1.5 and 2 times the mean."""
    rows = spark.read.option("multiLine", True).json(path)
    ms = lambda c: F.col(c) / 1000.0
    have = lambda c: ms(c) if c in rows.columns else F.lit(None).cast("double")
    return rows.select(
        "name",
        F.col("num_requests").cast("long").alias("requests"),
        F.col("num_failures").cast("long").alias("failures"),
        ms("avg_response_time").alias("mean"),
        F.coalesce(have("p95"), 1.5 * ms("avg_response_time")).alias("p95"),
        F.coalesce(have("p99"), 2.0 * ms("avg_response_time")).alias("p99"),
    )


def discover_cases(paths: DataFrame, registered: DataFrame) -> DataFrame:
    """(case_id, name) of top-level folders of paths(path) that are not registered."""
    folder = F.split(F.col("path"), "/")[0]
    slug = F.regexp_replace(F.lower(folder), "[_ ]", "-")
    found = paths.where(F.col("path").contains("/")).select(slug.alias("case_id")).distinct()
    return found.join(registered.select("case_id"), "case_id", "left_anti").withColumn(
        "name", F.initcap(F.translate("case_id", "-", " "))
    )


def split_extra(df: DataFrame, known: list[str]) -> DataFrame:
    """Known keys of metadata_extra become columns, the others stay in it."""
    out = df
    for name in known:
        if name not in df.columns:
            value = F.col("metadata_extra")[name]
            if name == "attachment_names":
                value = F.coalesce(F.nullif(value, F.lit("")), F.col("metadata_extra")["attachments"])
            out = out.withColumn(name, F.coalesce(value, F.lit("")))
    drop = F.array(*[F.lit(k) for k in (*known, "attachments")])
    return out.withColumn("metadata_extra", F.map_filter("metadata_extra", lambda k, v: ~F.array_contains(drop, k)))


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append, one folder for each case: a scan of one case reads its files only."""
    chunks.write.mode("append").partitionBy("case_id").parquet(path)


def write_records(df: DataFrame, path: str, id_col: str, most_records: int = 10_000, most_mb: float | None = None) -> int:
    """Append records as JSON lines after checking ids, number and size; the number written."""
    bad = df.where(~F.coalesce(F.col(id_col).rlike("^[A-Za-z0-9_-]+$"), F.lit(False))).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"invalid {id_col}")
    n = df.count()
    if n > most_records:
        raise ValueError(f"more than {most_records} records")
    if most_mb is not None:
        size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
        if size > most_mb * 1_000_000:
            raise ValueError(f"more than {most_mb} MB of records")
    df.write.mode("append").json(path)
    return n


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file of nested records."""
    report.coalesce(1).write.mode("overwrite").json(path)


def case_namespace(case_id: str) -> str:
    """Database name of a case."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", case_id or ""):
        raise ValueError("invalid case_id")
    return "case_" + case_id.replace("-", "_").lower()
