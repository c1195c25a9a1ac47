from __future__ import annotations

import numpy as np
import pytest

from caseloom.operators import vector_index
from caseloom.operators.retrieval import semantic_top

DIM = 24


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(60, DIM))
    x = (middles[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, DIM))).tolist()
    x += [x[0]] * 2500  # copies of one vector
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(90_000, None), (90_001, [0.0] * DIM), (90_002, [float("nan")] * DIM), (90_003, [1.0] * 3), (90_004, [2.0 * v for v in x[7]])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = [(k, (middles[k % 60] + 0.4 * rng.normal(size=DIM)).tolist()) for k in range(80)] + [(900, x[0]), (901, None), (902, [0.0] * DIM), (903, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, query_embedding array<double>")
    return vectors, queries


@pytest.fixture(scope="module")
def index(tables, tmp_path_factory):
    return vector_index.build(tables[0], f"file://{tmp_path_factory.mktemp('index')}")


def pairs(df):
    return {(r["query_id"], r["rank"]): (r["id"], round(r["similarity"], 7)) for r in df.collect()}


def test_exact_search_equals_a_scan(tables, index):
    vectors, queries = tables
    assert pairs(index.exact_search(queries, 10)) == pairs(semantic_top(vectors, queries, 10))


def test_slices_of_queries_give_the_same(tables, index, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERIES_AT_ONCE", 30)
    vectors, queries = tables
    assert pairs(index.exact_search(queries, 3, probe=1)) == pairs(semantic_top(vectors, queries, 3))


def test_recall(tables, index):
    vectors, queries = tables
    want, got = pairs(semantic_top(vectors, queries, 10)), pairs(index.search(queries, 10, probe=12))
    ids = lambda found: {(q, i) for (q, _), (i, _) in found.items()}
    plain = {k: v for k, v in want.items() if k[0] != 900}  # among copies any may be found
    assert len(ids(plain) & ids(got)) >= 0.95 * len(plain)
    assert all(s == pytest.approx(1, abs=1e-6) for (q, _), (_, s) in got.items() if q == 900)
    assert {k[0] for k in got} == {k[0] for k in want}


def test_fewer_cells_read_fewer_files(files_read, index):
    """The folders of cells that no query probes are not read."""
    counts = [files_read(index.table("codes", index.cells[:k])) for k in (1, 4, 16, len(index.cells))]
    assert counts == sorted(counts) and counts[0] < counts[1] < counts[2] < counts[3]
    assert counts[0] <= 2 and counts[3] >= len(index.cells)


def test_bounds_prune_cells(tables, index):
    """Exact searches leave cells out, and none that holds a better vector."""
    unit = np.array([r["query_embedding"] for r in tables[1].where("query_id < 80").collect()])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    bound = index._bounds(unit)
    for r in tables[0].where("id < 600").collect():
        x = np.array(r["embedding"]) / np.linalg.norm(r["embedding"])
        cell = int((index.centres @ x).argmax())
        assert (unit @ x <= bound[:, cell] + 1e-9).all()
    assert (bound < 0.5).mean() > 0.2


def test_empty_and_single(spark, tmp_path):
    none = vector_index.build(spark.createDataFrame([], "id long, embedding array<float>"), f"file://{tmp_path}/none")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_embedding array<double>")
    assert none.exact_search(asked, 3).count() == 0 and none.search(asked, 3).count() == 0
    one = vector_index.build(spark.createDataFrame([("a", [2.0, 0.0])], "id string, embedding array<float>"), f"file://{tmp_path}/one")
    assert [tuple(r) for r in one.search(asked, 3).collect()] == [(1, "a", 1.0, 1)] == [tuple(r) for r in one.exact_search(asked, 3).collect()]
