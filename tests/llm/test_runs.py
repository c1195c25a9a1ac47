from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import runs


def plain_runs(x):
    """All runs by comparing the sequence with itself at every distance."""
    found = set()
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            end = i + q
            smaller = any(all(x[k] == x[k + d] for k in range(start, end - d)) for d in range(1, q))
            if end - start >= max(6, 4 * q) and not smaller:
                found.add((start, end - start, q))
    return sorted(found)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    about = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *about, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences(rng, count):
    for _ in range(count):
        k, size, x = rng.choice([1, 2, 3, 5]), rng.randint(0, 60), []
        while len(x) < size:
            root = [rng.randrange(k) for _ in range(rng.randint(1, 7))]
            x += root * rng.randint(1, 7) + root[: rng.randint(0, len(root))]
        yield x[:size]


def test_equals_every_distance():
    for x in sequences(random.Random(3), 3000):
        assert runs.find_runs(np.array(x, np.int64)) == plain_runs(x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80))
def test_two_words(x):
    assert runs.find_runs(np.array(x, np.int64)) == plain_runs(x)


def test_hashes_alone_decide_nothing(monkeypatch):
    """With hashes that always agree, verification gives the same runs."""
    monkeypatch.setattr(runs.Extensions, "_agree", lambda self, i, j, size: True)
    for x in sequences(random.Random(4), 300):
        assert runs.find_runs(np.array(x, np.int64)) == plain_runs(x)


def test_long_periodic_texts_take_time_in_proportion():
    assert runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs.find_runs(np.tile(np.arange(500), 300)) == [(0, 150_000, 500)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    names = ["a", "b", "A", "é", " x", "long-word"]
    texts = [" ".join(names[v] for v in x) for x in sequences(rng, 200)]
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(3000)), None, "", " \t\n", "one", "x " * 6, "x " * 5, "a\x0bb\x0ca\rb\n" * 4]
    found = list(enumerate(texts))
    return found + [found[3], (None, "y " * 9), (-7, "q r " * 8)]


def test_digests(spark, rows):
    schema = "doc_id long, text string, n_runs string, start int"
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows], schema).repartition(4)
    got = sorted(map(tuple, runs.run_digests(df).collect()), key=str)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=str)
    assert runs.run_digests(df.limit(0)).count() == 0


def test_rows_of_runs_and_collapsed_texts(spark, rows):
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, `length` string")
    got = sorted(map(tuple, runs.periodic_runs(df).collect()), key=str)
    assert got == sorted(((i, *r) for i, t in rows for r in plain_runs((t or "").encode().split())), key=str)
    out = runs.collapse(df)
    assert out.columns == df.columns
    found = [tuple(r) for r in out.collect()]
    assert sorted(map(str, (r[0] for r in found))) == sorted(str(i) for i, _ in rows)
    assert (None, "y", "mine") in found and (-7, "q r", "mine") in found
    unchanged = {i: t for i, t in rows if not plain_runs((t or "").encode().split())}
    assert all(r[1] == unchanged[r[0]] for r in found if r[0] in unchanged)
