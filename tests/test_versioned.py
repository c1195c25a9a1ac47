from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseloom.sources.versioned import Conflict, UnderHold, VersionedTable


@pytest.fixture
def store(spark, tmp_path):
    rows = [(i, f"case{i // 100}", None if i % 10 == 0 else f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, case_id string, content string")
    table = VersionedTable(spark, f"file://{tmp_path}/t", df.schema, keys=("case_id",))
    table.append(df.repartitionByRange(6, "id"))
    return table


def test_only_touched_files_are_rewritten(store):
    before = store.current()
    assert len(before.files) == 6
    touched = store.touched("case_id = 'case2'")
    assert 0 < len(touched) < 4
    assert store.delete("case_id = 'case2' and id % 2 = 0") == 50
    after = store.current()
    assert set(before.files) - set(after.files) == set(store._touched(before, "case_id = 'case2' and id % 2 = 0"))
    assert store.read().count() == 550 and store.read().where("case_id = 'case2'").count() == 50
    assert store.read(before.number).count() == 600  # a reader of the version before keeps all of it
    assert store.delete("case_id = 'none'") == 0 and store.current().number == after.number


def test_nulls_stay(store):
    assert store.delete("content like 'text 1%'") == sum(str(i).startswith("1") for i in range(600) if i % 10)
    assert store.read().where("content is null").count() == 60


def test_holds(store):
    store.hold("matter 7", "case_id = 'case1'")
    before = store.current()
    with pytest.raises(UnderHold, match="matter 7"):
        store.delete(F.col("id") < 150)
    with pytest.raises(UnderHold):
        store.truncate()
    assert store.current() == before and store.read().count() == 600
    assert store.delete("id < 100") == 100
    store.release("matter 7")
    assert store.truncate() == 500 and store.read().count() == 0 and store.truncate() == 0


def test_a_hold_between_read_and_commit_wins(store, monkeypatch):
    written = store._written

    def later(df):
        monkeypatch.setattr(store, "_written", written)
        store.hold("late", "id = 5")
        return written(df)

    monkeypatch.setattr(store, "_written", later)
    with pytest.raises(Conflict):
        store.delete("id < 10")
    assert store.read().where("id < 10").count() == 10
    with pytest.raises(UnderHold):
        store.delete("id < 10")


def test_filters_reach_the_files(store):
    plan = store.read().where("case_id = 'case3'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(case_id,case3)" in plan
