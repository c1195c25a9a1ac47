"""Queries over whole features: the retriever, functions called from SQL, archives of records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import patterns as P
from caseloom.operators import governance, retrieval
from caseloom.plans import readonly_sql
from caseloom.queries import ANSWERS, DENSITY, INTENT, PII_UNION, QUESTIONS, SEMANTIC, TOKENS, answers, query, questions, table, with_vectors
from caseloom.queries import KEYWORD as KEYWORD_SQL
from caseloom.session import durable, shared_folder
from caseloom.sources import archive
from caseloom.sources.tables import append_chunks
from caseloom.sources.versioned import UnderHold, VersionedTable

# --- retriever --------------------------------------------------------------------------

#: Four documents in a row are the chunks of one message; every third message is attached to the
#: one before.
MESSAGES = """chunks AS (SELECT doc_id AS id, text AS content, embedding, 'm' || (doc_id // 4) AS message_id,
    CASE WHEN (doc_id // 4) % 3 = 1 THEN 'm' || (doc_id // 4 - 1) END AS parent_message_id, CAST(doc_id % 4 AS INTEGER) AS chunk_index,
    source AS email_from, lang AS email_to FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""


def message_chunks(spark: SparkSession, d: str) -> DataFrame:
    message = F.floor(F.col("doc_id") / 4).cast("long")
    none = F.lit(None).cast("string")
    return with_vectors(table(spark, d, "documents"), "doc_id", table(spark, d, "embeddings")).select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "embedding",
        F.concat(F.lit("m"), message.cast("string")).alias("message_id"),
        F.when(message % 3 == 1, F.concat(F.lit("m"), (message - 1).cast("string"))).alias("parent_message_id"),
        (F.col("doc_id") % 4).cast("int").alias("chunk_index"), F.col("source").alias("email_from"), F.col("lang").alias("email_to"),
        none.alias("email_subject"), none.alias("entity_name"),
    )


_OTHERS = "NOT EXISTS (SELECT 1 FROM hits x WHERE x.query_id = k.query_id AND x.id = c.id)"


@query(
    f"WITH {MESSAGES}, {QUESTIONS}, {SEMANTIC.format(n=30)}, {KEYWORD_SQL % 30}, "
    f"""s AS (SELECT query_id, id, round(sum(s), 12) AS rrf_score FROM (
      SELECT query_id, id, 0.7::DOUBLE / (60 + rank) AS s FROM semantic UNION ALL
      SELECT query_id, id, 0.3::DOUBLE / (60 + rank) FROM keyword) GROUP BY ALL),
    hits AS (SELECT query_id, id, rrf_score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) <= 10),
    h AS (SELECT hits.query_id, hits.id, message_id, parent_message_id, chunk_index FROM hits JOIN chunks ON chunks.id = hits.id),
    w AS (SELECT DISTINCT query_id, message_id, unnest([chunk_index - 1, chunk_index, chunk_index + 1]) AS chunk_index FROM h),
    near AS (SELECT k.query_id, c.id FROM w k JOIN chunks c ON c.message_id = k.message_id AND c.chunk_index = k.chunk_index WHERE {_OTHERS}),
    f AS (SELECT k.query_id, k.link, c.id, row_number() OVER (PARTITION BY k.query_id, k.link
        ORDER BY list_cosine_similarity(c.embedding::DOUBLE[], q.query_embedding::DOUBLE[]) DESC NULLS LAST, c.id) AS r
      FROM (SELECT DISTINCT query_id, message_id AS link FROM h) k JOIN questions q ON q.query_id = k.query_id
      JOIN chunks c ON c.parent_message_id = k.link WHERE {_OTHERS}),
    m AS (SELECT k.query_id, k.link, c.id, row_number() OVER (PARTITION BY k.query_id, k.link ORDER BY c.chunk_index, c.id) AS r
      FROM (SELECT DISTINCT query_id, parent_message_id AS link FROM h WHERE parent_message_id IS NOT NULL) k
      JOIN chunks c ON c.message_id = k.link WHERE {_OTHERS}),
    o AS (SELECT query_id, id, 0 AS o FROM hits UNION ALL SELECT query_id, id, 1 FROM near
      UNION ALL SELECT query_id, id, 2 FROM f WHERE r <= 2 UNION ALL SELECT query_id, id, 3 FROM m WHERE r <= 2),
    one AS (SELECT query_id, id, min(o) AS o FROM o GROUP BY ALL),
    t AS (SELECT id, message_id, list_concat({TOKENS.format('email_from')}, []) AS a, {TOKENS.format('email_to')} AS b, lower(content) AS body FROM chunks),
    q AS (SELECT query_id, {TOKENS.format('query')} AS tokens, regexp_extract_all(lower(query), '{P.DATE_MENTION}') AS dates FROM questions),
    sc AS (SELECT one.query_id, one.id, o, message_id, round(coalesce(rrf_score, 0.0::DOUBLE) + 0.15 * (len(list_intersect(tokens, a)) + len(list_intersect(tokens, b)))
      + 0.15 * len(list_filter(dates, lambda x: contains(body, x))), 9)::DOUBLE AS boosted_score
      FROM one JOIN t ON t.id = one.id JOIN q ON q.query_id = one.query_id LEFT JOIN hits ON hits.query_id = one.query_id AND hits.id = one.id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted_score DESC, id) AS rank FROM sc QUALIFY rank <= 10),
    sib AS (SELECT DISTINCT k.query_id, c.id FROM top k JOIN chunks c ON c.message_id = k.message_id
      WHERE NOT EXISTS (SELECT 1 FROM top x WHERE x.query_id = k.query_id AND x.id = c.id))
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(boosted_score, 6) AS boosted_score,
      list_extract(['search', 'neighbour', 'attachment', 'parent'], o + 1) AS origin FROM top
    UNION ALL SELECT query_id, id, 0, -1.0::DOUBLE, 'sibling' FROM sib"""
)
def retriever_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole retriever for all questions: both legs fused, neighbours, attachments, parents,
    boost, rerank, siblings."""
    found = retrieval.retrieve(message_chunks(spark, d), questions(spark, d), top_k=10)
    # siblings have no rank and no score
    return found.withColumn("boosted_score", F.coalesce(F.round("boosted_score", 6), F.lit(-1.0))).withColumn("rank", F.coalesce("rank", F.lit(0)))


# --- functions in SQL -------------------------------------------------------------------

FUNCTIONS_SQL = """
  SELECT 'density' AS name, content_density(text) AS value, count(*) AS n FROM documents GROUP BY content_density(text)
  UNION ALL SELECT 'intent', query_intent(q), count(*) FROM asked GROUP BY query_intent(q)
  UNION ALL SELECT 'citation', c.source, count(*) FROM (SELECT explode(cs) AS c FROM (SELECT citations(answer) AS cs FROM answers)) GROUP BY c.source
  UNION ALL SELECT 'pii', kind, sum(k) FROM (SELECT explode(counts) AS (kind, k) FROM (SELECT pii_counts(text) AS counts FROM documents)) GROUP BY kind
  UNION ALL SELECT 'values', 'all', sum(size(critical_values(text))) FROM documents
  UNION ALL SELECT 'similar', 'neighbours', count_if(cosine_similarity(a.embedding, b.embedding) > 0.5)
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
  UNION ALL SELECT 'chunked', 'conversations', count(DISTINCT key) FROM chunk_texts(
    TABLE(SELECT CAST(conv_id AS STRING) AS key, text, turn FROM conversations) PARTITION BY key ORDER BY turn)
"""


@query(
    f"""WITH {ANSWERS}, asked AS (SELECT lower(text) AS q FROM benchmark)
    SELECT 'density' AS name, density AS value, count(*) AS n FROM ({DENSITY.format(c='text', t='documents')}) GROUP BY density
    UNION ALL SELECT 'intent', {INTENT} AS i, count(*) FROM asked GROUP BY i
    UNION ALL SELECT 'citation', trim(c), count(*) FROM (SELECT unnest(regexp_extract_all(answer, '{P.CITATION}', 1)) AS c FROM answers) GROUP BY trim(c)
    UNION ALL SELECT 'pii', pii_type, CAST(sum(n) AS BIGINT) FROM ({PII_UNION}) WHERE n > 0 GROUP BY pii_type
    UNION ALL SELECT 'values', 'all', CAST(sum(len(regexp_extract_all(text, '{P.CRITICAL}'))) AS BIGINT) FROM documents
    UNION ALL SELECT 'similar', 'neighbours', count(*) FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
      WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.5
    UNION ALL SELECT 'chunked', 'conversations', count(DISTINCT conv_id) FROM conversations WHERE length(trim(text)) > 0"""
)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The library's functions called from read-only SQL over whole tables."""
    views = {t: table(spark, d, t) for t in ("documents", "conversations", "embeddings")}
    views["embeddings"] = views["embeddings"].withColumn("embedding", F.col("embedding").cast("array<double>"))
    views["answers"] = answers(spark, d)
    views["asked"] = table(spark, d, "benchmark").select(F.lower("text").alias("q"))
    return readonly_sql.run(spark, views, FUNCTIONS_SQL, limit=readonly_sql.MOST_ROWS, functions=True)


# --- archives ---------------------------------------------------------------------------


@query(
    """SELECT source AS custodian, 'Document ' || doc_id AS subject, source AS sender, lang AS sent,
      md5('Subject: Document ' || doc_id || E'\\nFrom: ' || source || E'\\nDate: ' || lang || CASE WHEN length(trim(text, E' \\n\\t\\r')) > 0
        THEN E'\\nTopic: ' || trim(text, E' \\n\\t\\r') ELSE '' END) AS text_md5 FROM documents"""
)
def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """The documents as an export of records, a folder a custodian, read by the data source."""
    path = f"{shared_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    records = table(spark, d, "documents").select(
        F.col("source").alias("custodian"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("Subject/Title"),
        F.col("source").alias("Sender"), F.col("lang").alias("Date"), F.col("text").alias("Conversation topic"),
    )
    records.write.partitionBy("custodian").json(path)
    archive.register(spark)
    rows = spark.read.format("case_archive").load(path if "://" in path or path.startswith("file:") else f"file://{path}")
    out = durable(rows.select("custodian", "subject", "sender", "sent", F.md5("text").alias("text_md5")))
    _remove(spark, path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# --- deletes under hold -----------------------------------------------------------------


@query(
    """SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE NOT (source = 'src1' AND lang <> 'en') AND NOT (source = 'src2' AND n_chars < 2000)"""
)
def delete_under_hold(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the documents after two deletes, and a refused one of rows under hold."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    store = VersionedTable(spark, path, docs.schema, keys=("source",))
    store.append(docs.repartition("source", F.pmod(F.xxhash64("doc_id"), F.lit(8))))
    store.hold("inquiry", "source = 'src1' AND lang = 'en'")
    store.delete("source = 'src1' AND lang <> 'en'")
    try:
        store.delete("source = 'src1'")
    except UnderHold:
        pass
    store.delete("source = 'src2' AND n_chars < 2000")
    out = durable(store.read().select("doc_id", F.md5("text").alias("text_md5")))
    _remove(spark, path)
    return out


# --- diagnostics ------------------------------------------------------------------------


@query("SELECT lang AS case_id, count(*) AS rows, true AS stored, true AS own_files FROM documents GROUP BY lang")
def relation_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each case in a stored table, and whether its files have a size and are its own."""
    path = f"{shared_folder(spark).rstrip('/')}/sizes-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").withColumnRenamed("lang", "case_id")
    append_chunks(docs, path)
    stored = spark.read.parquet(path)
    sizes = governance.relation_sizes(stored, "case_id")
    shared = governance.stored_files(stored, "case_id").groupBy("file").agg(F.count_distinct("key").alias("keys"), F.first("key").alias("key"))
    own = shared.groupBy("key").agg((F.max("keys") == 1).alias("own_files"))
    out = durable(sizes.join(own, "key").select(F.col("key").alias("case_id"), "rows", (F.col("bytes") > 0).alias("stored"), "own_files"))
    _remove(spark, path)
    return out


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls,"
        f" {f'count(*) FILTER (length(trim({c})) = 0)' if text else 'CAST(0 AS BIGINT)'} AS blanks,"
        f" {f'round(avg(strlen({c})), 4)' if text else '-1.0::DOUBLE'} AS mean_bytes FROM documents"
        for c, text in (("doc_id", False), ("text", True), ("lang", True), ("source", True), ("n_chars", False))
    )
)
def column_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    found = governance.column_diagnostics(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return found.select("column", "rows", "nulls", "blanks", F.coalesce(F.round("mean_bytes", 4), F.lit(-1.0)).alias("mean_bytes"))
