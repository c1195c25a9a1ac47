from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from caseloom import feature_queries, index_queries, source_queries, time_queries  # noqa: F401  add their queries to core's
from caseloom import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(map(str, r)) for r in frame[names].astype(object).where(frame[names].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, SF)
    if name in core.ORACLES:
        got, want = got.toPandas(), duck.sql(core.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert got.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_texts_are_not_shuffled_for_vectors(spark, tmp_path):
    """Searches by words leave the join with vectors out; a vec_id that repeats gives rows as SQL does."""
    spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/a/documents.parquet")
    vectors = spark.createDataFrame([(i, [float(i)], 0) for i in range(2, 12)], "vec_id long, embedding array<float>, label int")
    vectors.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    found = core.chunks(spark, f"{tmp_path}/a")
    plan = found.select("id", "content")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted((r["id"], r["embedding"]) for r in found.collect()) == [(i, [float(i)] if i > 1 else None) for i in range(9)]
    vectors.union(vectors.where("vec_id < 4")).write.mode("overwrite").parquet(f"{tmp_path}/b/embeddings.parquet")
    twice = core.with_vectors(spark.read.parquet(f"{tmp_path}/a/documents.parquet"), "doc_id", spark.read.parquet(f"{tmp_path}/b/embeddings.parquet"))
    assert twice.count() == 11
