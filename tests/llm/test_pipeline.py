from __future__ import annotations

import random

import pytest

import corpus_pipeline
from caseloom.llm import mixing, packing

pytest.importorskip("public_tokenizers")
INSULTS = ["grumble", "snark", "blight"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["the", "of", "and", "to"] + [f"en{i}" for i in range(2000)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(12, 60))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(INSULTS)
        rows.append((i, " ".join(text), "en", f"s{i % 5}", 0, 9))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    copies = [(10_000 + n, r[1] + (" end" if n % 2 else ""), *r[2:]) for n, r in enumerate(clean[:60])]
    secret = (20_000, "of the token = 0123456789abcdef0123456789abcdef and more", "en", "s1", 0, 9)
    extra = [secret, clean[0], (None, "no id of the text", None, None, None, None), (30_000, None, "en", "s2", 0, 9)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    spark.createDataFrame(rows + copies + extra, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, clean, copies


def test_stages(spark, tables, tmp_path):
    path, rows, clean, copies = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, found = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        found[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {name: [r["doc_id"] for r in got] for name, got in found.items()}
    kept = set(ids["toxicity"])
    toxic = {r[0] for r in rows if r[0] % 4 == 0}
    assert len(toxic & kept) < 0.1 * len(toxic) and len({r[0] for r in clean} & kept) > 0.97 * len(clean)
    assert all(r["score"] in (9, None) for r in found["toxicity"])
    again = ids["near_dedup"]
    assert not {c[0] for c in copies} & set(again) and len(again) == len(set(again)) and None in again and 30_000 in again
    masked = {r["doc_id"]: r["text"] for r in found["secrets"]}
    assert sorted(masked, key=str) == sorted(again, key=str) and masked[20_000] == "of the [SECRET] and more"
    assert sorted(ids["mixing"], key=str) == sorted(again, key=str)
    assert {r["doc_id"] for r in found["packing"]} == set(again)
    assert sum(r["doc_tokens"] for r in found["packing"] if r["start"] == 0) == sum(r["length"] for r in found["packing"])
    run = corpus_pipeline.run(spark, path).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in run) == sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in found["packing"])


def test_mixing_shapes_the_sequences(spark, tmp_path, monkeypatch):
    """The order of the mixing stage decides which documents share a sequence and its number."""
    text = "some of the words of a document " * 40
    rows = [(i, f"{text}{i}", "hot" if i < 600 else f"s{i % 2}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    source = {i: s for i, _, s in rows}
    monkeypatch.setattr(packing.pack, "__defaults__", (*packing.pack.__defaults__[:2], 128, *packing.pack.__defaults__[3:]))
    found = []
    for name, weights in (("hot", {"hot": 8, "s0": 1, "s1": 1}), ("even", {"hot": 1, "s0": 1, "s1": 1})):
        mixing.mixed_documents(docs, weights).write.parquet(f"file://{tmp_path}/{name}")
        mixed = spark.read.parquet(f"file://{tmp_path}/{name}")
        placed = {r["doc_id"]: r["p"] for r in mixing.file_positions(mixed, "p").collect()}
        want = {r["doc_id"]: r["mix_position"] for r in mixing.mix(docs, weights).collect()}
        assert placed == want
        got = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
        assert sorted(r["doc_id"] for r in got if r["start"] == 0) == sorted(source)
        assert all(r["sequence_id"] >> packing.GROUP_SHIFT == placed[r["doc_id"]] // 128 for r in got)
        early = {r["doc_id"] for r in sorted(got, key=lambda r: r["sequence_id"]) if placed[r["doc_id"]] < 256}
        assert {r["doc_id"] for r in got if r["sequence_id"] >> packing.GROUP_SHIFT < 2} == early
        found.append((sum(source[i] == "hot" for i in early) / len(early), {(r["doc_id"], r["start"]): (r["sequence_id"], r["offset"]) for r in got}))
    assert found[0][1] != found[1][1]
    assert found[0][0] > 0.7 and 0.25 < found[1][0] < 0.45


def test_near_dedup_keeps_each_text_of_an_id(spark):
    one, other = "the first text of this id with more than five words", "a second and quite different text of the same id"
    rows = [(1, one), (1, one), (1, other), (2, one + " "), (3, "a b"), (4, "a"), (5, None), (5, None), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    left = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, one), (1, other), (3, "a b"), (4, "a"), (5, None), (None, one)], key=str)


@pytest.mark.parametrize("rows", [[], [("", "s")] * 2, [("token = abc", "s")], [("one source alone " * 200_000, "s"), ("a b", "s")]])
def test_small_and_long_tables(spark, tables, tmp_path, rows):
    """An empty table, one source, texts of a few words and a very long one through all stages."""
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in got} == set(range(len(rows)))
