"""The question pipeline as a batch: retrieve, grade, rewrite, answer, check, guard.

State is one wide row for each query.  The rewrite loop is a bounded number of passes over the
queries that are not accepted yet; external models are scorers with offline defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions import text as T
from caseloom.operators import grounding, retrieval
from caseloom.session import durable

MOST_LOOPS = 3
COVERAGE = 0.3


def lexical_grade(query: Column, content: Column) -> Column:
    """Share of the query's tokens that the documents hold."""
    tokens = T.unicode_tokens(query)
    return F.size(F.array_intersect(tokens, T.unicode_tokens(content))) / F.greatest(F.size(tokens), F.lit(1))


def shortened(query: Column, loop: int) -> Column:
    """Rewriting offline: the longest half, quarter, ... of the query's words, in order."""
    words = F.split(query, r"\s+")
    keep = F.greatest(F.lit(1), F.ceil(F.size(words) / (2**loop)).cast("int"))
    ranked = F.slice(F.reverse(F.array_sort(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))), F.lit(1), keep)
    return F.array_join(F.transform(F.array_sort(F.transform(ranked, lambda r: F.struct((-r["i"]).alias("i"), r["w"].alias("w")))), lambda r: r["w"]), " ")


def _retrieve(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    hits = retrieval.hybrid_search(chunks, queries, top_k).select("query_id", "id", "rrf_score", "rank")
    if retrieval.few(queries, retrieval.MOST_QUERIES):
        hits = F.broadcast(hits)  # top_k ids a query; the texts stay where they are
    return hits.join(chunks.select("id", "content", "source"), "id")


def answer(chunks: DataFrame, queries: DataFrame, top_k: int = 5, loops: int = MOST_LOOPS) -> DataFrame:
    """(query_id, intent, loops, grade, answer, citations, grounding, unsupported_claims,
    critical_facts, risk, decision): one row a query."""
    todo = queries.select("query_id", "query", "query_embedding", F.col("query").alias("asked"))
    done = None
    for loop in range(loops + 1):
        hits = _retrieve(chunks, todo, top_k)
        docs = hits.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", "id", "source", F.col("content").alias("text")))).alias("docs")
        )
        state = todo.join(docs, "query_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast(docs.schema["docs"].dataType)))
        body = F.array_join(F.transform("docs", lambda x: x["text"]), " ")
        state = state.withColumn("grade", F.when(lexical_grade(F.col("query"), body) >= COVERAGE, "yes").otherwise("no")).withColumn("loops", F.lit(loop))
        state = durable(state)  # top_k texts a query; each pass starts from a table
        final = grounding.route(F.col("grade"), F.col("loops"), loops) == "validator"
        part = state.where(final)
        done = part if done is None else done.unionByName(part)
        if loop < loops:
            todo = state.where(~final).select("query_id", shortened(F.col("asked"), loop + 1).alias("query"), "query_embedding", "asked")
    return _respond(done)


def _respond(state: DataFrame) -> DataFrame:
    """Extractive answers with citations, checked against the retrieved documents: citations by
    their sources, claims by shared words, critical values by the documents that hold them."""
    line = lambda x: F.concat(F.element_at(T.sentences(x["text"]), 1), F.lit(" [Source: "), x["source"], F.lit("]"))
    text = F.array_join(F.transform(F.slice("docs", 1, 3), line), " ")
    texts = F.transform("docs", lambda x: x["text"])
    out = state.withColumn("intent", T.intent(F.col("asked"))).withColumn("answer", text)
    out = out.withColumn("report", grounding.validate_citations(F.col("answer"), F.transform("docs", lambda x: x["source"])))
    out = out.withColumn("unsupported", grounding.unsupported_claims(F.col("answer"), texts))
    out = out.withColumn("facts", grounding.local_facts(F.col("answer"), texts))
    total, bad = F.size("report"), F.size(F.filter("report", lambda c: ~c["is_valid"]))
    severity = F.transform("unsupported", lambda c: F.when(F.size(T.critical_values(c)) > 0, "critical").otherwise("major"))
    weak = F.size(F.filter("facts", lambda f: ~f["is_sufficiently_supported"]))
    args = (total, bad, severity, F.size("facts"), weak)
    risk = grounding.risk_score(*args)
    score = grounding.grounding_score(F.col("report"))
    out = out.withColumn("risk", F.round(risk, 4)).withColumn("decision", grounding.risk_decision(risk))
    noted = grounding.grounding_notice(F.col("answer"), F.col("report"), F.col("unsupported"))
    return out.select(
        "query_id", "intent", "loops", "grade",
        grounding.guarded_answer(noted, F.col("decision"), F.col("risk"), grounding.risk_flags(*args)).alias("answer"),
        total.alias("citations"), grounding.grounding_status(score).alias("grounding"),
        F.size("unsupported").alias("unsupported_claims"), F.size("facts").alias("critical_facts"), "risk", "decision",
    )


def trace(state: DataFrame) -> DataFrame:
    """(query_id, step, node): the nodes each query went through, in order."""
    loop = F.flatten(F.transform(F.sequence(F.lit(0), F.col("loops")), lambda i: F.when(i == 0, F.array(F.lit("retriever"), F.lit("grader"))).otherwise(F.array(F.lit("rewriter"), F.lit("retriever"), F.lit("grader")))))
    nodes = F.concat(F.array(F.lit("intent")), loop, F.array(F.lit("validator"), F.lit("generator"), F.lit("guard")))
    return state.select("query_id", F.posexplode(F.slice(nodes, 1, 50)).alias("step", "node"))


def preview(chunks: DataFrame, queries: DataFrame, top_k: int = 6) -> DataFrame:
    """The best chunks of each query, their text cut to 300 characters."""
    k = min(max(top_k, 1), 20)
    rows = _retrieve(chunks, queries, k)
    order = Window.partitionBy("query_id").orderBy("rank")
    return rows.select("query_id", F.row_number().over(order).alias("rank"), "id", "source", F.substring("content", 1, 300).alias("snippet"))
