from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from caseloom.llm import near_dedup, textcore

WORDS = [f"w{i}" for i in range(3000)]


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows, limit):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    parent = {i: i for i in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, v in sets.items() if i is not None for s in v if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            both = len(a & b)
            if both >= Fraction(limit) * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    base = [rng.choices(WORDS, k=rng.randint(30, 200)) for _ in range(12)]
    for b in base:
        out.append(" ".join(b))
        for share in (0, 0.002, 0.01, 0.02, 0.03, 0.05):
            out.append(" ".join(edited(rng, b, share)))
    big = rng.choices(WORDS, k=150)  # a large group of different near copies
    out += [" ".join(edited(rng, big, rng.choice([0.005, 0.01, 0.02, 0.04]))) for _ in range(150)]
    out += ["same text of just six words"] * 40 + ["Same  TEXT of\tjust six\nwords"]
    out += ["", None, " \n ", "one", "one", "one two three four", "ONE two three four"]
    out += [" ".join(rng.choices(WORDS, k=20000))] * 2
    rng.shuffle(out)
    found = list(enumerate(out))
    return found + [(5, found[5][1]), (6, "an id with a second and quite different text")]


@pytest.mark.parametrize("limit", [0.8, 0.85, 0.855])
def test_equals_brute_force(spark, rows, limit):
    schema = "doc_id long, text string, n_shingles string, component_id int"
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], schema).repartition(5)
    got = near_dedup.near_duplicates(df, limit).collect()
    assert len(got) == len(rows)
    want = expected(rows, str(limit))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    sizes = {(r["doc_id"], r["n_shingles"]) for r in got}
    assert sizes == {(i, len(shingle_set(t))) for i, t in rows}


def test_null_id_and_empty_table(spark):
    schema = "doc_id long, text string"
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, None, True), (1, 1, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_registers_of_a_union_are_maxima():
    rng = np.random.default_rng(1)
    a, b = (np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (400, 90))
    union = np.unique(np.concatenate([a, b]))
    regs = near_dedup.set_sketches(np.concatenate([a, b, union]), np.array([0, 400, 490, 490 + len(union)]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for shared in (100, 500, 900):
        a = np.sort(pool[:1000])
        b = np.sort(np.concatenate([pool[:shared], pool[1000 : 2000 - shared]]))
        regs = near_dedup.set_sketches(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        up, down = (regs[:1] > regs[1:]).sum(1), (regs[:1] < regs[1:]).sum(1)
        got = near_dedup.similarity_likelihood(up, down, np.array([1000]), np.array([1000]))[0]
        assert abs(got - shared / (2000 - shared)) < 0.12


def test_segments_do_not_change_hashes(monkeypatch):
    text = " ".join(WORDS).encode()
    whole = textcore.word_hashes(text)[0]
    monkeypatch.setattr(textcore, "SEGMENT_BYTES", 500)
    assert (textcore.word_hashes(text)[0] == whole).all()
    assert len(np.unique(whole)) == len(WORDS)


@pytest.mark.parametrize("total", range(7))
def test_shingles_of_runs_with_few_words(total):
    """Every way to deal up to six words to texts that are hashed together."""
    words = [f"w{i}" for i in range(total)]
    for cuts in range(1 << max(0, total - 1)):
        texts = [[]]
        for i, w in enumerate(words):
            texts[-1].append(w)
            if cuts >> i & 1:
                texts.append([])
        found = []
        for first, last, hashes, offsets, _ in textcore.batch_word_hashes([" ".join(t).encode() for t in texts]):
            _, limits = textcore.shingles(hashes, offsets, 5)
            found += np.diff(limits).tolist()
        assert found == [len(shingle_set(" ".join(t))) for t in texts]


def test_short_texts_alone_in_a_run(spark):
    schema = "doc_id long, text string"
    long = " ".join(WORDS[:500] * 700)  # over SEGMENT_BYTES: what lies between two of these is a run
    assert len(long) > textcore.SEGMENT_BYTES
    tables = [
        [(1, "token = abc")],
        [(1, "a"), (2, "a b")],
        [(1, None), (2, "a b")],
        [(1, long), (2, "a b"), (3, long), (4, "a"), (5, "a"), (6, long + " b")],
    ]
    for rows in tables:
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, schema).coalesce(1), 0.85).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == expected(rows, "0.85")
        assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(t)) for i, t in rows}
