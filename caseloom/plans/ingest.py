"""Ingestion as one plan: files, documents, chunks, protection, vectors, table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import chunking, enrichment
from caseloom.plans.cache import Cache
from caseloom.session import durable
from caseloom.sources import files, tables

MAIL_FIELDS = ["message_id", "thread_id", "parent_message_id", "email_subject", "email_from", "email_to", "email_date", "attachment_names"]


def chunk_rows(
    documents: DataFrame, case_id: str, doc_type: str | None = None, entity_name: str | None = None, pii: str | None = None,
    dim: int = 1024, model=None, enrich: bool = False,
) -> DataFrame:
    """Rows of the chunk table for loaded documents.  The id is a hash of case, source, page and
    place, so that reading a file again gives the same ids."""
    docs = tables.split_extra(documents.where("content is not null").drop("error"), MAIL_FIELDS)
    chunks = chunking.chunk_documents(docs).withColumn("case_id", F.lit(case_id))
    chunks = chunks.withColumn("doc_type", F.lit(doc_type)).withColumn("entity_name", F.lit(entity_name))
    chunks = chunks.withColumn("message_id", F.when(F.col("message_id") != "", F.col("message_id")).otherwise(F.lit("")))
    chunks = chunks.withColumn("id", F.xxhash64("case_id", "source", "page", "chunk_index", "content"))
    if pii:
        chunks = enrichment.protect(chunks, pii)
    chunks = enrichment.embed(chunks, dim, model)
    return enrichment.enrich(chunks) if enrich else chunks


def ingest(
    spark: SparkSession, folder: str, path: str, case_id: str, cache: Cache | None = None, **options
) -> DataFrame:
    """Read the folder, append its chunks to the table at path, and return the report.  Sources
    that the case already has are skipped."""
    tables.case_namespace(case_id)
    loaded = durable(files.read_documents(spark, folder))
    rows = loaded
    try:
        stored = spark.read.parquet(path).where(F.col("case_id") == case_id)
        rows = loaded.join(stored.select("source").distinct(), "source", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if not rows.where("content is not null").isEmpty():
        tables.append_chunks(chunk_rows(rows, case_id, **options), path)
    if cache:
        cache.invalidate_prefix(f"retrieval:{case_id}:")
    return files.ingestion_report(loaded)
