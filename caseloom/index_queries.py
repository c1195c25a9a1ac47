"""Queries that write an index of the test tables to the shared folder and search it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import text_index, vector_index
from caseloom.queries import CHUNKS, QUESTIONS, SEMANTIC, chunks, query, questions, table
from caseloom.session import durable, shared_folder


def _searched(spark: SparkSession, build, search) -> DataFrame:
    """What search finds in an index that build writes to a new path; the index is deleted."""
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    out = durable(search(build(path)))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return out


@query(f"WITH {CHUNKS}, {QUESTIONS}, {SEMANTIC.format(n=10)} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM semantic")
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """As semantic_topk, from the cells of an index that can hold the nearest."""
    asked = questions(spark, d)
    out = _searched(spark, lambda path: vector_index.build(chunks(spark, d), path), lambda index: index.exact_search(asked, 10))
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _text_index(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    out = _searched(spark, lambda path: text_index.build(docs, path, analyser="plain"), lambda index: index.search(asked, 10))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH q AS (SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS word FROM benchmark),
    a AS (SELECT query_id, word, count(*) AS times FROM q GROUP BY ALL),
    c AS (SELECT doc_id AS id, unnest({WORDS.format('text')}) AS word FROM documents),
    p AS (SELECT id, word, count(*) AS n FROM c GROUP BY ALL),
    s AS (SELECT query_id, id, round(sum(times * n * 0.1::DOUBLE), 6) AS score FROM a JOIN p USING (word) GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10"""
)
def fulltext_index_any_word(spark: SparkSession, d: str) -> DataFrame:
    """Documents for any word of each benchmark item, by the index."""
    # in quotes, as a word of an item may be "or"
    words = F.transform(F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " or ").alias("query"))
    return _text_index(spark, d, items)


@query(
    f"""WITH q AS (SELECT item_id AS query_id, {WORDS.format('text')} AS ws FROM benchmark),
    b AS (SELECT query_id, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS pair FROM q),
    a AS (SELECT query_id, pair[1] AS w1, pair[2] AS w2, count(*) AS times FROM b GROUP BY ALL),
    d AS (SELECT doc_id AS id, {WORDS.format('text')} AS ws FROM documents),
    o AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
    h AS (SELECT DISTINCT x.id, x.word AS w1, y.word AS w2 FROM o x JOIN o y ON x.id = y.id AND y.pos = x.pos + 1
      JOIN (SELECT DISTINCT w1, w2 FROM a) n ON n.w1 = x.word AND n.w2 = y.word),
    m AS (SELECT h.id, w1, w2, pos, word, lag(pos) OVER w AS prev_pos, lag(word) OVER w AS prev_word
      FROM h JOIN o ON o.id = h.id AND (o.word = w1 OR o.word = w2) WINDOW w AS (PARTITION BY h.id, w1, w2 ORDER BY pos)),
    c AS (SELECT id, w1, w2, sum(CASE WHEN w1 = w2 THEN 0.1::DOUBLE WHEN prev_word <> word THEN 0.1::DOUBLE / (pos - prev_pos) ELSE 0.0::DOUBLE END) AS density
      FROM m GROUP BY ALL),
    s AS (SELECT query_id, id, round(sum(times * density), 6) AS score FROM a JOIN c USING (w1, w2) GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10"""
)
def fulltext_index_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents for any two neighbouring words of each benchmark item as a phrase, by the index."""
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"')))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(pairs, " or ").alias("query"))
    return _text_index(spark, d, items)
