from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from caseloom.sources import archive


def mbox(n, name, rng):
    out = []
    for i in range(n):
        body = "\n".join(f"line {k} of {name} {i} {'x' * rng.randint(0, 60)}" for k in range(rng.randint(1, 6)))
        quoted = ">From the start\n" if i % 5 == 0 else ""
        out.append(f"From a{i}@b.c Mon Jan  1 00:00:00 2024\nSubject: {name} {i}\nFrom: a{i}@b.c\nDate: Mon, 01 Jan 2024 00:00:00 +0000\n\n{quoted}{body}\n\n")
    return "".join(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(3)
    root = tmp_path_factory.mktemp("cases")
    for custodian in ("ann", "bob", "cy"):
        (root / custodian / "deep").mkdir(parents=True)
        (root / custodian / "mail.mbox").write_text(mbox(40, custodian, rng))
        (root / custodian / "deep" / "one.eml").write_bytes(b"Subject: =?utf-8?q?caf=C3=A9?=\r\nFrom: x@y.z\r\n\r\nHello\r\n")
        records = [{"Subject/Title": f"s{i}", "Sender": f"{custodian}@x", "Date": "2024", "To": "you"} for i in range(30)]
        (root / custodian / "items1.json").write_text(json.dumps(records))
        (root / custodian / "log.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records) + "not json\n[1]\n\n")
    (root / "other.json").write_text("[]")
    (root / "empty.mbox").write_text("")
    (root / "_hidden").mkdir()
    (root / "_hidden" / "x.eml").write_text("Subject: no\n\nno")
    return root


def load(spark, folder, **options):
    archive.register(spark)
    return spark.read.format("case_archive").options(**options).load(f"file://{folder}")


def test_rows(spark, folder):
    rows = load(spark, folder).collect()
    kinds = {k: sum(r["kind"] == k for r in rows) for k in ("mail_archive", "mail", "record_items", "record_lines")}
    assert kinds == {"mail_archive": 120, "mail": 3, "record_items": 90, "record_lines": 90} and len(rows) == 303
    mail = next(r for r in rows if r["kind"] == "mail" and r["custodian"] == "bob")
    assert (mail["subject"], mail["sender"], mail["text"], mail["file"]) == ("café", "x@y.z", "Hello", "bob/deep/one.eml")
    first = next(r for r in rows if r["subject"] == "ann 0")
    assert first["text"].startswith("From the start\nline 0 of ann 0") and first["position"] == 0
    item = next(r for r in rows if r["kind"] == "record_items")
    assert item["text"] == f"Subject: s{item['position']}\nFrom: {item['custodian']}@x\nTo: you\nDate: 2024"


@pytest.mark.parametrize("size", [1, 97, 1000, 5000])
def test_ranges_give_every_row_once(spark, folder, size):
    want = sorted(map(tuple, load(spark, folder).where("kind in ('mail_archive', 'record_lines') and custodian = 'ann'").collect()))
    got = []
    for f in archive.listed(f"file://{folder}"):
        if f.custodian == "ann" and f.kind in ("mail_archive", "record_lines"):
            reader = archive.ArchiveReader(f"file://{folder}", size)
            parts = archive._parts([f], size)
            assert len(parts) == max(1, -(-f.size // size))
            got += [row for p in parts for row in reader.read(p)]
    assert sorted(got) == want


def test_large_files_are_many_tasks(spark, folder):
    df = load(spark, folder, range_bytes=1000)
    assert df.rdd.getNumPartitions() > 12
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, load(spark, folder).collect()))


def test_filters_choose_files(spark, folder):
    """A pushed filter leaves fewer files to open, and no filter in Spark's plan."""
    df = load(spark, folder)
    everything = df.rdd.getNumPartitions()
    some = df.where((F.col("custodian") == "bob") & F.col("kind").isin("mail", "record_items"))
    assert everything == 13 and some.rdd.getNumPartitions() == 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("isnotnull", "") or "bob" not in plan.split("BatchScan")[0]
    assert {(r["custodian"], r["kind"]) for r in some.collect()} == {("bob", "mail"), ("bob", "record_items")}
    assert df.where("custodian = 'nobody'").count() == 0
    assert df.where("custodian = 'cy' and subject = 's3'").count() == 2  # Spark applies what is left


def test_stream_equals_batch(spark, folder, tmp_path):
    """All files come once, new ones in the next run, from the same checkpoint."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(folder / "ann", copy / "ann")
    archive.register(spark)

    def run():
        rows = spark.readStream.format("case_archive").load(f"file://{copy}")
        q = rows.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").option("path", f"file://{tmp_path}/out")
        q.trigger(availableNow=True).start().awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))

    want = lambda: sorted(map(tuple, load(spark, copy).collect()))
    assert run() == want() and len(want()) == 101
    shutil.copytree(folder / "bob", copy / "bob", copy_function=shutil.copy)  # new modification times
    assert run() == want() and len(want()) == 202


def test_empty_folder_and_missing_path(spark, tmp_path):
    assert load(spark, tmp_path).count() == 0 and load(spark, tmp_path / "none").count() == 0
