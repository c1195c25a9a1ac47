"""Embedding and enrichment of chunks, personal data over chunks, claim verification."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions import text as T
from caseloom.functions.vectors import hash_embedding
from caseloom.session import durable

BATCH = 48


def embed(chunks: DataFrame, dim: int = 1024, model=None) -> DataFrame:
    """chunks with `embedding`.  Each distinct text is embedded once.

    model: a function that makes, once for each task, a function from a list of texts to a list
    of vectors; without one the deterministic hash embedding is used.
    """
    if model is None:
        return chunks.withColumn("embedding", hash_embedding(F.coalesce("content", F.lit("")), dim))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for pdf in batches:
            texts = pdf["content"].tolist()
            vectors = [v for at in range(0, len(texts), BATCH) for v in encode(texts[at : at + BATCH])]
            yield pd.DataFrame({"content": texts, "embedding": [list(map(float, v)) for v in vectors]})

    distinct = chunks.where("content is not null").select("content").distinct()
    return chunks.join(distinct.mapInPandas(run, "content string, embedding array<double>"), "content", "left")


def keywords(chunks: DataFrame, n: int = 5, least: int = 20) -> DataFrame:
    """(id, keywords): the n tokens of highest tf-idf of each chunk of `least` or more
    characters; idf over all chunks, ties in order of the token.

    Tokens are counted where the chunks are.  The MOST_TOKENS commonest ones' frequencies go to all
    tasks; of any other a task knows the most and the least that it can score, so only tokens that
    may be among a chunk's best are joined with their frequencies.
    """
    texts = chunks.where(F.length("content") >= least)
    tokens = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    rows = texts.select("id", tokens.alias("tokens"))
    ids = texts.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    total, times = ids.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
    if times > 1:  # the texts of an id are one
        twice = ids.where("times > 1").select(F.col("id").alias("twice"))
        same = F.col("id").eqNullSafe(F.col("twice"))
        merged = rows.join(twice, same, "left_semi").groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        rows = rows.join(twice, same, "left_anti").unionByName(merged)
    # a token that is not in it is in one chunk
    found = rows.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = durable(found.where("df > 1"))
    best = _candidates(rows, df, total, n).join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    score = F.round(F.col("tf") * F.log(F.lit(total) / F.col("df")), 9)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "token")
    best = best.withColumn("score", score).withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "token"))).alias("k")).select(
        "id", F.transform("k", lambda x: x["token"]).alias("keywords")
    )


#: Tokens whose frequencies go to all tasks.
MOST_TOKENS = 1 << 17
#: Scores are rounded to nine digits; bounds leave so much room.
ROOM = 2e-9


def _candidates(rows: DataFrame, df: DataFrame, total: int, n: int) -> DataFrame:
    """(id, token, tf): of rows(id, tokens), the tokens that may be among the n best."""
    sizes = sorted(((r["df"], r["count"]) for r in df.groupBy("df").count().collect()), reverse=True)  # a row a frequency
    rest, held = max((d for d, _ in sizes), default=1), 0  # no token outside the map is more frequent
    for d, count in sizes:
        if (held := held + count) > MOST_TOKENS:
            break
        rest = d - 1
    common = df.where(F.col("df") > rest).toArrow()  # at most MOST_TOKENS
    idf = {t: math.log(total / d) for t, d in zip(common["token"].to_pylist(), common["df"].to_pylist(), strict=True)}
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    low, high = math.log(max(total, 1) / rest), math.log(max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                owner, token, tf = [], [], []
                for row, words in enumerate(part.column(1).to_pylist()):
                    counts = Counter(words)
                    sure = heapq.nlargest(n, (k * idf.get(t, low) for t, k in counts.items()))
                    beat = sure[-1] - ROOM if len(sure) == n else -1.0
                    for t, k in counts.items():
                        if k * idf.get(t, high) >= beat:
                            owner.append(row)
                            token.append(t)
                            tf.append(k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int32())), pa.array(token, pa.string()), pa.array(tf, pa.int64())], ["id", "token", "tf"]
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, token string, tf long")


def enrich(chunks: DataFrame, n: int = 5) -> DataFrame:
    """chunks with keywords in metadata_extra and at the end of content; short ones as they are."""
    out = chunks.join(keywords(chunks, n), "id", "left")
    joined = F.array_join("keywords", ", ")
    none = F.create_map().cast("map<string,string>")
    return out.withColumn(
        "metadata_extra",
        F.when(F.col("keywords").isNotNull(), F.map_concat(F.coalesce("metadata_extra", none), F.create_map(F.lit("keywords"), joined))).otherwise(F.col("metadata_extra")),
    ).withColumn("content", F.when(F.col("keywords").isNotNull(), F.concat("content", F.lit("\n\nKeywords: "), joined)).otherwise(F.col("content"))).drop("keywords")


def protect(chunks: DataFrame, mode: str = "redact") -> DataFrame:
    """chunks with pii_counts; in mode redact also with their personal data masked."""
    if mode not in ("redact", "detect"):
        raise ValueError("mode is redact or detect")
    out = chunks.withColumn("pii_counts", T.pii_counts(F.coalesce("content", F.lit(""))))
    return out.withColumn("content", T.redact_pii(F.col("content"))) if mode == "redact" else out


def protection_report(chunks: DataFrame) -> DataFrame:
    """(pii_type, total, chunks) over chunks with pii_counts."""
    return chunks.select(F.explode("pii_counts").alias("pii_type", "n")).groupBy("pii_type").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("chunks")
    )


def verify_claims(claims: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """claims with is_valid: whether the reference table has a row with the claim's keys."""
    found = reference.select(*keys).distinct().withColumn("_found", F.lit(True))
    return claims.join(found, keys, "left").withColumn("is_valid", F.coalesce("_found", F.lit(False))).drop("_found")


def relevance_proxy(query: Column, answer: Column) -> Column:
    """Offline judge of relevance: share of the query's tokens that the answer holds."""
    q = T.unicode_tokens(query)
    return F.size(F.array_intersect(q, T.unicode_tokens(answer))) / F.greatest(F.size(q), F.lit(1))


def faithfulness_proxy(answer: Column, docs: Column) -> Column:
    """Offline judge of faithfulness: share of the answer's tokens that a document holds."""
    tokens = T.unicode_tokens(answer)
    known = F.array_distinct(F.flatten(F.transform(docs, T.unicode_tokens)))
    return F.size(F.array_intersect(tokens, known)) / F.greatest(F.size(tokens), F.lit(1))
