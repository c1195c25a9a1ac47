from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseloom.operators import evaluation, governance, metrics, temporal

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(4)
    at = lambda: T0 + timedelta(seconds=rng.randrange(0, 300_000, 10))
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    left = [(i, key(), at() if i % 50 else None) for i in range(500)]
    right = [(key(), at(), n, None if n % 11 == 0 else n / 2) for n in range(200)]
    return left, right


@pytest.mark.parametrize(("width", "within"), [(86_400, None), (1_000, None), (7_000, 20_000)])
def test_asof_join_equals_a_loop(spark, sides, width, within):
    left, right = sides
    got = temporal.asof_join(
        spark.createDataFrame(left, "id int, k string, ts timestamp").repartition(4), spark.createDataFrame(right, "k string, ts timestamp, n int, v double"),
        ["k"], "ts", ["n", "v"], order=["n"], slice_seconds=width, within=within,
    )
    assert got.columns == ["id", "k", "ts", "n", "v"]
    for r in got.collect():
        best = max(((t, n, v) for k, t, n, v in right if r["k"] and k == r["k"] and r["ts"] and t <= r["ts"]), key=lambda x: x[:2], default=None)
        if best and within and (r["ts"] - best[0]).total_seconds() > within:
            best = None
        assert (r["n"], r["v"]) == (best[1:] if best else (None, None))
    assert got.count() == len(left)


def test_interval_join_equals_a_loop(spark, sides):
    left, right = sides
    spans = [(i, k, t, t + timedelta(seconds=(i * 997) % 30_000)) for i, k, t in left if t]
    got = temporal.interval_join(
        spark.createDataFrame(spans, "id int, k string, start timestamp, stop timestamp"), spark.createDataFrame(right, "k string, ts timestamp, n int, v double"),
        ["k"], "start", "stop", "ts", slice_seconds=5_000,
    )
    want = sorted((i, n) for i, k, a, b in spans for rk, t, n, _ in right if k and k == rk and a <= t < b)
    assert sorted((r["id"], r["n"]) for r in got.collect()) == want and len(want) > 100


def test_late_rows_are_kept_apart_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    folder = tmp_path / "in"
    folder.mkdir()
    batches, at = [], 0
    for b in range(5):
        rows = []
        for i in range(40):
            at += rng.randint(1, 60)
            rows.append((b * 100 + i, rng.choice("xy"), T0 + timedelta(seconds=at - rng.choice([0, 0, 0, 30, 900]))))
        batches.append(rows)
    batches[2].append((999, "x", None))

    def run(first, last):
        for b in range(first, last):
            spark.createDataFrame(batches[b], "id int, k string, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/t{b}")
            for f in (tmp_path / f"t{b}").glob("*.parquet"):
                f.rename(folder / f"{b}.parquet")
        rows = spark.readStream.schema("id int, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
        q = temporal.split_late(rows, "ts", 120, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
        q.awaitTermination(200)
        assert q.exception() is None

    run(0, 3)
    run(3, 5)
    want_late, latest = set(), None
    for rows in batches:
        want_late |= {i for i, _, t in rows if t is None or (latest and t < latest - timedelta(seconds=120))}
        latest = max([t for _, _, t in rows if t] + ([latest] if latest else []))
    late = {r["id"] for r in spark.read.parquet(f"file://{tmp_path}/out/late").collect()}
    on_time = spark.read.parquet(f"file://{tmp_path}/out/on_time")
    assert late == want_late and len(late) > 5
    assert {r["id"] for r in on_time.collect()} == {i for rows in batches for i, _, _ in rows} - late
    told = temporal.counts(spark, f"file://{tmp_path}/out").agg(F.sum("on_time"), F.sum("late")).first()
    assert tuple(told) == (201 - len(late), len(late))
    kept = sorted((k, t) for rows in batches for i, k, t in rows if i not in late)
    islands = []
    for k, t in kept:
        if islands and islands[-1][0] == k and t - islands[-1][2] <= timedelta(seconds=100):
            islands[-1] = (k, islands[-1][1], t, islands[-1][3] + 1)
        else:
            islands.append((k, t, t, 1))
    got = temporal.sessions(on_time, ["k"], gap="100 seconds")
    assert sorted(map(tuple, got.select("k", "start", "end", "n").collect())) == islands


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(5)
    values = [rng.expovariate(1) for _ in range(20_000)]
    df = spark.createDataFrame([("m", T0 + timedelta(seconds=i), v) for i, v in enumerate(values)], "name string, ts timestamp, value double").repartition(6)
    sketches = metrics.quantile_sketches(df, "10 minutes").cache()
    ordered = sorted(values)
    for part in (sketches, sketches.orderBy(F.desc("window")), sketches.repartition(7)):
        rows = metrics.sketch_quantiles(metrics.merged_sketches(part)).collect()
        assert [r["n"] for r in rows] == [20_000] * 3
        for r in rows:
            rank = sum(v <= r["value"] for v in ordered) / len(ordered)
            assert abs(rank - r["q"]) <= metrics.RANK_ERROR
    two_step = metrics.merged_sketches(metrics.merged_sketches(sketches.withColumn("half", F.hour("window.start") % 2), ("name", "half")))
    assert two_step.first()["n"] == 20_000


def test_document_cards_by_every_key(spark):
    rng = random.Random(6)
    rows = [(i, "m1" if i < 300 else None, "re" if 300 <= i < 400 else "", "bob" if 300 <= i < 350 else None, rng.choice([0, 1, None]), None if i % 13 == 0 else "x" * rng.randint(0, 90)) for i in range(420)]
    df = spark.createDataFrame(rows, "id long, message_id string, email_subject string, email_from string, chunk_index int, content string").repartition(4)
    got = {r["card"]: (r["chunks"], r["content"]) for r in governance.document_cards(df, most=500).collect()}
    groups = {}
    for r in rows:
        card = r[1] or (f"{r[2] or ''}||{r[3] or ''}" if r[2] or r[3] else f"id:{r[0]}")
        groups.setdefault(card, []).append(r)
    want = {}
    for card, members in groups.items():
        members.sort(key=lambda r: (r[4] is not None, r[4] or 0, r[0]))
        want[card] = (len(members), "\n\n".join(r[5] for r in members if r[5] is not None)[:500])
    assert got == want and "re||bob" in got and "re||" in got


def test_rank_metrics_equal_the_functions_on_lists(spark):
    rng = random.Random(7)
    retrieved = [(k, rng.choice("abcdefgh"), rank) for k in range(12) for rank in range(1, rng.randint(2, 9))]
    relevant = [(k, x) for k in range(2, 14) for x in rng.sample("abcdefgh", rng.randint(1, 5))]
    got = {r["key"]: r for r in evaluation.rank_metrics(
        spark.createDataFrame(retrieved, "key int, item string, rank int"), spark.createDataFrame(relevant, "key int, item string"), 4).collect()}
    lists = spark.createDataFrame(
        [(k, [x for q, x, _ in retrieved if q == k], [x for q, x in relevant if q == k]) for k in range(12)], "key int, r array<string>, g array<string>"
    ).select("key", evaluation.precision_at_k(F.col("r"), F.col("g"), 4).alias("p"), evaluation.recall_at_k(F.col("r"), F.col("g"), 4).alias("q"), evaluation.reciprocal_rank(F.col("r"), F.col("g")).alias("m"))
    for r in lists.collect():
        assert (got[r["key"]]["precision_at_k"], got[r["key"]]["reciprocal_rank"]) == (r["p"], r["m"])
        assert got[r["key"]]["recall_at_k"] == pytest.approx(r["q"])
