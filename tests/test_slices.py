"""Operators that take queries or values in slices give what one slice gives."""

from __future__ import annotations

from caseloom.operators import grounding, retrieval
from caseloom.plans import keyword, readonly_sql


def test_queries_in_slices(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}", [float(i % 5), 1.0]) for i in range(60)], "id long, content string, embedding array<double>")
    queries = spark.createDataFrame([(k, f"word{k % 7}", [float(k), 2.0]) for k in range(25)], "query_id long, query string, query_embedding array<double>")
    found = lambda: [sorted(map(tuple, f(chunks, queries, 4).collect())) for f in (retrieval.semantic_top, retrieval.keyword_top, keyword.ranked_top)]
    want = found()
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 6)
    monkeypatch.setattr(keyword, "MOST_QUERIES", 6)
    assert found() == want and len(want[0]) == 100


def test_values_in_slices(spark, monkeypatch):
    claims = spark.createDataFrame([(i, f"It cost ${i}00 on 2020-01-{i + 10}.") for i in range(9)], "claim_id long, claim string")
    docs = spark.createDataFrame([(i, f"we paid ${i % 4}00") for i in range(30)], "doc_id long, content string")
    found = lambda: sorted(map(tuple, grounding.supported_facts(claims, docs).collect()))
    want = found()
    monkeypatch.setattr(grounding, "MOST_VALUES", 3)
    assert found() == want and any(r[2] for r in want)


def test_comment_marks_within_literals(spark):
    view = {"t": spark.createDataFrame([(1,)], "x int")}
    sql = r"SELECT 'a\n--b' AS y, 'it\'s /* no */' AS z FROM t -- a comment" + "\n/* another */;"
    assert tuple(readonly_sql.run(spark, view, sql).first()) == ("a\n--b", "it's /* no */")
