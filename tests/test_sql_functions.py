from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseloom.functions import registry
from caseloom.functions import text as T
from caseloom.operators.chunking import email_segments, split_recursively
from caseloom.plans import readonly_sql

TEXTS = [
    "Pay $1,200.50 by 2021-03-04 to a.b@example.com, phone 555-123-4567 [Source: a/b.pdf, p. 3].", "When did it's happen? <p>x &amp; y</p>", "", None,
    "Hey, thanks!\nlol ok\ncu soon " * 5, "pursuant hereby whereas shall " * 40, "Summarize the key findings: 15% or 3,000",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")


@pytest.mark.parametrize("name", [n for n, (p, _) in registry.SQL_FUNCTIONS.items() if p == "t string"])
def test_sql_functions_equal_columns(spark, docs, name):
    registry.register(spark)
    docs.createOrReplaceTempView("sql_docs")
    make = registry.SQL_FUNCTIONS[name][1]
    want = docs.select("id", make(F.col("t")).alias("v"))
    got = spark.sql(f"SELECT id, {name}(t) AS v FROM sql_docs")
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_cosine(spark):
    registry.register(spark)
    got = spark.sql("SELECT cosine_similarity(array(1.0D, 0.0D), array(1.0D, 1.0D)) AS a, cosine_similarity(array(0.0D), array(1.0D)) AS b").first()
    assert got["a"] == pytest.approx(0.5**0.5) and got["b"] is None


def test_table_functions_by_partition(spark):
    rows = [(f"k{i % 3}", i, f"part {i} " * (90 if i % 2 else 5)) for i in range(30)] + [("k9", 0, None), ("k8", 0, "From: a@b.c\nTo: d@e.f\nSubject: x\n\nBody text here.\n\n> quoted")]
    views = {"mails": spark.createDataFrame(rows, "key string, n int, content string").repartition(4)}
    sql = "SELECT * FROM chunk_texts(TABLE(SELECT key, content, n FROM mails) PARTITION BY key ORDER BY n)"
    got = readonly_sql.run(spark, views, sql, limit=1000, functions=True).collect()
    for key in {r[0] for r in rows}:
        parts = split_recursively("\n\n".join(c for k, _, c in rows if k == key and c)) if key != "k9" else []
        assert [(r["chunk_index"], r["total_chunks"], r["content"]) for r in sorted(got, key=lambda r: r["chunk_index"]) if r["key"] == key] == [(n, len(parts), p) for n, p in enumerate(parts)]
    sql = "SELECT key, count(*) AS n FROM mail_segments(TABLE(SELECT key, content FROM mails)) GROUP BY key"
    assert {r["key"]: r["n"] for r in readonly_sql.run(spark, views, sql, functions=True).collect()}["k8"] == len(email_segments(rows[-1][2]))


def test_functions_are_refused_where_not_asked_for(spark, docs):
    sql = "SELECT content_density(t) AS d FROM docs"
    with pytest.raises(readonly_sql.NotReadOnly):
        readonly_sql.run(spark, {"docs": docs}, sql)
    assert readonly_sql.run(spark, {"docs": docs}, sql, functions=True).count() == len(TEXTS)
    for bad in ("SELECT * FROM chunk_texts(TABLE(SELECT * FROM other))", "SELECT * FROM unknown_function(TABLE(docs))", "SELECT java_method('a', 'b')"):
        with pytest.raises(readonly_sql.NotReadOnly):
            readonly_sql.run(spark, {"docs": docs}, bad, functions=True)


def test_lines_of_a_text_are_found_once(spark):
    """Each use of the lines within the expression would split the text again."""
    assert registry.sql_text(T.content_density(F.col("t"))).count("split(regexp_replace(regexp_replace(") == 1
