from __future__ import annotations

import random

import pytest

from caseloom import index_queries
from caseloom.operators import text_index
from caseloom.plans.keyword import ranked_top

WORDS = "running runner ran apples apple quick quickly brown fox foxes jumped jumping over the lazy dogs and naïve café 42 nations national".split()
ASKED = [
    "apple", "running fox", '"quick brown"', '"quick brown fox" or dogs', "fox -lazy", 'apples -"lazy dogs"', "apple apple", "apple or apple or national",
    "the and", "", None, "absent", "absent or café", "-fox", '"brown brown"', "quick fox jumped lazy dogs", '42 "naïve café" or -apple running', 'fox -absent',
]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, weights=[1 + (i % 5) for i in range(len(WORDS))], k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["apple " * 60, "quick brown fox " * 30, None, "", "The-quick_brown fox; foxes'", "quick brown x fox fox"] + [texts[3]] * 120
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(5)
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    return chunks, queries


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("range_docs", [50, 100_000])
def test_equals_the_scan_of_texts(spark, tables, tmp_path, range_docs):
    chunks, queries = tables
    index = text_index.build(chunks, f"file://{tmp_path}/i", range_docs=range_docs)
    want = rows(ranked_top(chunks, queries, 5))
    assert rows(index.search(queries, 5)) == want and len(want) > 40


def test_plain_words_and_slices(spark, tables, tmp_path, monkeypatch):
    chunks, queries = tables
    index = text_index.build(chunks, f"file://{tmp_path}/p", analyser="plain", range_docs=64)
    whole = rows(index.search(queries, 3))
    monkeypatch.setattr(text_index, "MOST_QUERIES", 4)
    monkeypatch.setattr(text_index, "FIRST_RANGES", 1)
    assert rows(index.search(queries, 3)) == whole
    texts = {r["id"]: (r["content"] or "").lower().split() for r in chunks.collect()}
    runs = {i: t.count("running") for i, t in texts.items() if "running" in t}
    best = sorted(runs.items(), key=lambda x: (-x[1], x[0]))[:3]
    got = index.search(spark.createDataFrame([(1, "running")], "query_id long, query string"), 3)
    assert rows(got) == [(1, k + 1, i, round(0.1 * n, 6)) for k, (i, n) in enumerate(best)]
    freq = {r["word"]: r["docs"] for r in index.frequencies({"running", "42", "zz"}).collect()}
    assert freq == {"running": len(runs), "42": sum("42" in t for t in texts.values())}


def test_only_folders_of_the_words_are_read(files_read, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "FOLDER_POSTINGS", 100)
    index = text_index.build(tables[0], f"file://{tmp_path}/f", range_docs=64)
    assert index.folders > 10
    few, many = index.blocks({"fox"}), index.blocks({"fox", "appl", "run", "quick", "brown", "jump", "lazi", "dog"})
    assert 0 < files_read(few) < files_read(many)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan


def test_bounds_leave_ranges_out(spark, tables, tmp_path, monkeypatch):
    """A range whose best possible score is below the n-th found is not evaluated."""
    monkeypatch.setattr(text_index, "FIRST_RANGES", 1)
    index = text_index.build(tables[0], f"file://{tmp_path}/b", analyser="plain", range_docs=40)
    seen = []
    evaluated = text_index.TextIndex._evaluated
    monkeypatch.setattr(text_index.TextIndex, "_evaluated", lambda self, asked, *a: seen.append(asked.count()) or evaluated(self, asked, *a))
    got = index.search(spark.createDataFrame([(1, "apple")], "query_id long, query string"), 1)
    assert got.first()["score"] == 6.0 and sum(seen) < index.ranges


def test_empty(spark, tmp_path):
    index = text_index.build(spark.createDataFrame([], "id long, content string"), f"file://{tmp_path}/e")
    assert index.search(spark.createDataFrame([(1, "word")], "query_id long, query string"), 3).count() == 0


def test_a_word_of_an_item_may_be_or(spark, tmp_path):
    docs = ["this or that or those", "this", "or", "that that that", "none"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "This or that: or")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = index_queries.fulltext_index_any_word(spark, str(tmp_path))
    assert rows(got) == [(1, 1, 0, 0.6), (1, 2, 3, 0.3), (1, 3, 2, 0.2), (1, 4, 1, 0.1)]


def test_blocks_move_once_whatever_the_conjunctions(spark, tmp_path):
    """Postings of a common word are not copied for each conjunction that names it."""
    docs = spark.createDataFrame([(i, f"common w{i % 40} common w{i % 39} end") for i in range(2000)], "id long, content string").repartition(2)
    index = text_index.build(docs, f"file://{tmp_path}/c", analyser="plain", range_docs=500)
    asked = spark.createDataFrame([(i, f'"common w{i}" or "w{i} common"') for i in range(40)], "query_id long, query string")

    def moved():
        jvm = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    got = index.search(asked, 3).collect()
    # 80 conjunctions by 2,000 postings of "common" were over 160,000 rows
    assert len(got) == 120 and moved() - before < 5_000
