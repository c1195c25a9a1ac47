"""Batch retrieval: filters, vector and keyword legs, rank fusion, stitching, boosting.

All operators take many queries at once.  The chunks are scanned once for all queries, which are
broadcast, their number being checked; each task keeps the best rows of each query, so what is
shuffled is bounded by tasks x queries x limit, not by the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions import text as T
from caseloom.functions.vectors import cosine
from caseloom.operators.topn import BLOCK_SCORES, Best, best_rows, ids_of
from caseloom.session import durable

#: Queries, and tokens of queries, that are broadcast to one scan of the chunks; their number is
#: counted first, and more queries take further scans.
MOST_QUERIES, MOST_TOKENS = 10_000, 1_000_000


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows, without counting many more."""
    return df.limit(most + 1).count() <= most


def slices_of(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """df in parts of about `most` rows by a hash of key; df itself where it has no more."""
    if few(df, most):
        return [df]
    kept = durable(df)
    parts = -(-kept.count() // most)
    return [kept.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]


@dataclass(frozen=True)
class CaseScope:
    """The only way to a case's chunks: a scope without a case id cannot be made."""

    case_id: str

    def __post_init__(self) -> None:
        if not self.case_id or not self.case_id.strip():
            raise ValueError("case_id is required")

    def chunks(self, table: DataFrame) -> DataFrame:
        return table.where(F.col("case_id") == self.case_id)


KNOWN_FILTERS = ("doc_type", "entity_name", "source", "page", "chunk_type", "message_id", "thread_id")


def apply_filters(df: DataFrame, filters: dict, ignore_unknown: bool = False) -> DataFrame:
    """Equality on columns; <column>_contains case-insensitive substrings; <column>_from and
    <column>_to inclusive ranges.  Null values are skipped; unknown columns raise."""
    for name, value in filters.items():
        if value is None:
            continue
        if name.endswith("_contains") and name[:-9] in df.columns:
            df = df.where(F.lower(F.col(name[:-9])).contains(str(value).lower()))
        elif name.endswith("_from") and name[:-5] in df.columns:
            df = df.where(F.col(name[:-5]) >= F.lit(value))
        elif name.endswith("_to") and name[:-3] in df.columns:
            df = df.where(F.col(name[:-3]) <= F.lit(value))
        elif name in df.columns:
            df = df.where(F.col(name) == F.lit(value))
        elif not ignore_unknown:
            raise ValueError(f"unknown filter column: {name}")
    return df


def merge_filters(user: dict | None, case: dict | None) -> dict:
    """The case's filters win over the user's."""
    return {**(user or {}), **{k: v for k, v in (case or {}).items() if v is not None}}


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """rank and the first n rows of each query."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(
        F.col("rank") <= n
    )


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of norm 1, and which of them there are: those of the width, of finite norm above 0."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    rows = np.flatnonzero(sizes == width)
    x = np.zeros((len(column), width))
    if len(rows):
        flat = (column if len(rows) == len(column) else column.take(pa.array(rows))).flatten()
        x[rows] = flat.to_numpy(zero_copy_only=False).reshape(len(rows), width)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    x[good] /= norm[good, None]
    x[~good] = 0
    return x, good


def semantic_top(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, similarity, rank): the n chunks nearest to each query's vector.

    Products of the queries' matrix with blocks of chunks; chunks without a vector, or with one of
    another length or of norm 0, have no similarity and are left out.  The chunks are scanned once
    for each MOST_QUERIES queries.
    """
    found = None
    for part in slices_of(queries, "query_id", MOST_QUERIES):
        rows = _semantic_slice(chunks, part, n)
        found = rows if found is None else found.unionByName(rows)
    return _top(found, n, F.desc_nulls_last("similarity"), F.asc("id"))


def _semantic_slice(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, similarity): each task's n nearest chunks of each query."""
    asked = queries.select("query_id", F.col("query_embedding").cast("array<double>").alias("v")).where("v is not null").toArrow()
    names, vectors = (asked[c].combine_chunks() for c in ("query_id", "v"))
    width = int(pc.max(pc.list_value_length(vectors)).as_py() or 1) if len(names) else 1
    unit, good = _unit(vectors, width)
    names, unit = names.filter(pa.array(good)), unit[good]
    step = max(1, BLOCK_SCORES // max(1, len(unit)))

    def fill(best: Best, batch: pa.RecordBatch) -> None:
        x, known = _unit(batch.column(1), width)
        ids = ids_of(batch.column(0))
        for at in range(0, len(x), step):
            scores = np.round(unit @ x[at : at + step].T, 9)
            scores[:, ~known[at : at + step]] = -np.inf
            best.add_block(ids[at : at + step], scores)

    rows = chunks.where("embedding is not null").select("id", F.col("embedding").cast("array<double>"))
    return best_rows(rows, names, "similarity", n, "double", fill)


def keyword_top(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, hits, rank): chunks with at least one of the query's tokens, those with
    most different ones first.

    Tokens of all queries are looked up in each chunk, whose hits are counted in place; beyond
    MOST_QUERIES queries or MOST_TOKENS tokens an equi-join on tokens does the same.
    """
    q = queries.select("query_id", F.explode(T.unicode_tokens(F.col("query"))).alias("token"))
    tokens = F.array_distinct(T.unicode_tokens(F.col("content")))
    if not (few(q, MOST_TOKENS) and few(queries, MOST_QUERIES)):
        c = chunks.select("id", F.explode(tokens).alias("token"))
        hits = c.join(q, "token").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("hits"))
        return _top(hits, n, F.desc("hits"), F.asc("id"))
    pairs = q.distinct().toArrow()
    names = pc.unique(pairs["query_id"])
    words = pc.unique(pairs["token"])
    owner = pc.index_in(pairs["query_id"], names).to_numpy()
    word = pc.index_in(pairs["token"], words).to_numpy()
    order = np.argsort(word, kind="stable")
    owner, starts = owner[order], np.searchsorted(word[order], np.arange(len(words) + 1))
    step = max(1, BLOCK_SCORES // max(1, len(names)))

    def fill(best: Best, batch: pa.RecordBatch) -> None:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            lists = part.column(1)
            place = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), words), -1))
            row = np.repeat(np.arange(len(part)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            row, place = row[place >= 0], place[place >= 0]
            sizes = starts[place + 1] - starts[place]
            # all queries of each token: positions starts[p], starts[p] + 1, ... of owner
            flat = np.arange(sizes.sum()) + np.repeat(starts[place] - (np.cumsum(sizes) - sizes), sizes)
            hits = np.bincount(owner[flat] * len(part) + np.repeat(row, sizes), minlength=len(names) * len(part))
            scores = hits.reshape(len(names), len(part)).astype(float)
            scores[scores == 0] = -np.inf
            best.add_block(ids_of(part.column(0)), scores)

    found = best_rows(chunks.select("id", tokens), names, "hits", n, "long", fill)
    return _top(found, n, F.desc("hits"), F.asc("id"))


def fuse(
    semantic: DataFrame, keyword: DataFrame, top_k: int, semantic_weight: float = 0.7, keyword_weight: float = 0.3, k: int = 60
) -> DataFrame:
    """(query_id, id, rrf_score): weighted reciprocal ranks added up, the best top_k per query."""
    part = lambda df, w: df.select("query_id", "id", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("s"))
    both = part(semantic, semantic_weight).unionByName(part(keyword, keyword_weight))
    total = both.groupBy("query_id", "id").agg(F.round(F.sum("s"), 12).alias("rrf_score"))
    return _top(total, top_k, F.desc("rrf_score"), F.asc("id"))


def hybrid_search(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = 100,
    semantic_weight: float = 0.7,
    keyword_weight: float = 0.3,
    k: int = 60,
) -> DataFrame:
    """Both legs over-fetch three times top_k and are fused."""
    n = 3 * top_k
    return fuse(
        semantic_top(chunks, queries, n), keyword_top(chunks, queries, n), top_k, semantic_weight, keyword_weight, k
    )


def stitch_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """hits (query_id, id, message_id, chunk_index) and, once, the chunks of the same message at
    most `window` places away that are not among them; stitched tells which."""
    want = (
        hits.where("message_id is not null and message_id != ''")
        .select("query_id", "message_id", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
        .where("chunk_index >= 0")
        .distinct()
    )
    found = chunks.select("id", "message_id", "chunk_index").join(want, ["message_id", "chunk_index"])
    new = found.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").dropDuplicates(["query_id", "id"])
    return hits.select("query_id", "id", "message_id", "chunk_index", F.lit(False).alias("stitched")).unionByName(
        new.select("query_id", "id", "message_id", "chunk_index", F.lit(True).alias("stitched"))
    )


def complete_siblings(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits and, at their end, all other chunks of their messages; is_sibling tells which."""
    messages = hits.where("message_id is not null and message_id != ''").select("query_id", "message_id").distinct()
    new = chunks.select("id", "message_id", "chunk_index").join(messages, "message_id").join(
        hits.select("query_id", "id"), ["query_id", "id"], "left_anti"
    )
    return hits.select("query_id", "id", "message_id", "chunk_index", F.lit(False).alias("is_sibling")).unionByName(
        new.select("query_id", "id", "message_id", "chunk_index", F.lit(True).alias("is_sibling"))
    )


def linked_top(hits: DataFrame, chunks: DataFrame, left: str, right: str, k: int = 2, by_similarity: bool = False) -> DataFrame:
    """The k chunks of each linked message: left is the hits' key, right the chunks' one.

    Attachments of a mail: left message_id, right parent_message_id; the mail of an attachment:
    left parent_message_id, right message_id.  In order of similarity to the query's vector,
    or of chunk_index.
    """
    keys = hits.where(f"{left} is not null and {left} != ''").select(
        "query_id", F.col(left).alias("link"), *(["query_embedding"] if by_similarity else [])
    ).dropDuplicates(["query_id", "link"])
    found = chunks.withColumn("link", F.col(right)).join(keys, "link").join(
        hits.select("query_id", "id"), ["query_id", "id"], "left_anti"
    )
    order = (
        [F.desc_nulls_last(cosine(F.col("embedding"), F.col("query_embedding")))] if by_similarity else [F.asc("chunk_index")]
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "link").orderBy(*order, F.asc("id")))
    return found.withColumn("link_rank", rank).where(F.col("link_rank") <= k)


def merge_dedup(docs: DataFrame, order: Column) -> DataFrame:
    """The first row of each (query_id, id); rows without an id all stay."""
    rank = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(order))
    kept = docs.where("id is not null").withColumn("_n", rank).where("_n = 1").drop("_n")
    return kept.unionByName(docs.where("id is null"))


def metadata_boost(
    query: Column, email_from: Column, email_to: Column, entity: Column, subject: Column, content: Column,
    weight: float = 0.15, stale: Column | None = None, penalty: float = 0.05,
) -> Column:
    """weight for each query token among those of sender, recipient and entity, half of it for
    each in the subject, and weight for each date of the query that the text mentions; less the
    penalty where stale (a chunk without any date), if that column is given."""
    tokens = T.unicode_tokens(query)
    hits = lambda c: F.size(F.array_intersect(tokens, T.unicode_tokens(F.coalesce(c, F.lit("")))))
    body = F.lower(F.coalesce(content, F.lit("")))
    dates = F.size(F.filter(T.date_mentions(query), lambda d: body.contains(d)))
    boost = weight * (hits(email_from) + hits(email_to) + hits(entity)) + weight / 2 * hits(subject) + weight * dates
    return boost if stale is None else boost - F.when(stale, F.lit(penalty)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, scorer=None, top_n: int = 100) -> DataFrame:
    """hits with rerank_score, the best top_n of each query, and their rank before (from 0).

    scorer: a function of the hits' columns to a score column; the boosted score by default.
    """
    score = scorer(hits) if scorer else F.col("boosted_score")
    before = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boosted_score"), F.asc("id"))) - 1
    scored = hits.withColumn("original_rank", before).withColumn("rerank_score", score)
    return _top(scored, top_n, F.desc("rerank_score"), F.asc("original_rank"))


def rerank_with_fallback(hits: DataFrame, scorers: list, top_n: int = 100) -> tuple[DataFrame, str]:
    """rerank() by the first of scorers, (name, function) pairs, that can be applied, else by the
    order of the hits; the result and the name of what ranked it.

    A scorer that raises while it builds its column, as one without its service does, is skipped.
    """
    for name, scorer in scorers:
        try:
            out = rerank(hits, scorer, top_n)
            out.schema  # noqa: B018  resolves the column
            return out, name
        except Exception:  # noqa: BLE001, S112  any failure of a service means the next one
            continue
    return rerank(hits, None, top_n), "none"


def retrieve(
    chunks: DataFrame, queries: DataFrame, top_k: int = 100, window: int = 1, linked: int = 2, scorers: list | None = None,
    top_n: int | None = None, filters: dict | None = None,
) -> DataFrame:
    """The whole retriever: filters, both legs fused, neighbours, attachments and parents, boost by
    metadata, reranking, siblings.

    chunks(id, content, embedding, message_id, parent_message_id, chunk_index, email_from, email_to,
    email_subject, entity_name); queries(query_id, query, query_embedding).  Returns (query_id, id,
    rank, boosted_score, origin): reranked rows first, then their siblings.  Rows that the search
    did not find have no score of their own: only the boost.
    """
    found = apply_filters(chunks, filters or {})
    # at most top_k rows a query, which six parts of the plan read
    hits = durable(hybrid_search(found, queries, top_k).select("query_id", "id", "rrf_score"))
    place = found.select("id", "message_id", "parent_message_id", "chunk_index", "embedding")
    rows = hits.join(place, "id").join(queries.select("query_id", "query_embedding"), "query_id")
    near = stitch_neighbours(rows, found, window).where("stitched").select("query_id", "id", F.lit("neighbour").alias("origin"))
    files = linked_top(rows, found, "message_id", "parent_message_id", linked, by_similarity=True)
    mails = linked_top(rows, found, "parent_message_id", "message_id", linked)
    part = lambda df, name: df.select("query_id", "id", F.lit(name).alias("origin"))
    order = F.create_map(*[F.lit(x) for kv in (("search", 0), ("neighbour", 1), ("attachment", 2), ("parent", 3)) for x in kv])
    all_rows = part(hits, "search").unionByName(near).unionByName(part(files, "attachment")).unionByName(part(mails, "parent"))
    merged = merge_dedup(all_rows, order[F.col("origin")])
    text = found.select("id", "message_id", "chunk_index", "email_from", "email_to", "entity_name", "email_subject", "content")
    boost = metadata_boost(*[F.col(c) for c in ("query", "email_from", "email_to", "entity_name", "email_subject", "content")])
    scored = (
        merged.join(hits, ["query_id", "id"], "left").join(text, "id").join(queries.select("query_id", "query"), "query_id")
        .withColumn("boosted_score", F.round(F.coalesce("rrf_score", F.lit(0.0)) + boost, 9))
    )
    ranked, _ = rerank_with_fallback(scored, scorers or [], top_n or top_k)
    ranked = durable(ranked.select("query_id", "id", "message_id", "chunk_index", "rank", "boosted_score", "origin"))
    more = complete_siblings(ranked, found).where("is_sibling").select(
        "query_id", "id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("boosted_score"), F.lit("sibling").alias("origin")
    )
    return ranked.select("query_id", "id", "rank", "boosted_score", "origin").unionByName(more)
