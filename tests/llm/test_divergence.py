from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from caseloom.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least):
    """The result in plain Python: every group against every other."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs_of, counts = {}, {}
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(fold))
        docs_of.setdefault(lang or "", Counter()).update(set(terms))
        counts.setdefault((lang or "", source or ""), Counter()).update(terms)
    out = []
    for lang in docs_of:
        kept = sorted((t for t, n in docs_of[lang].items() if n >= least), key=str.encode)
        mine = {s: c for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for c in mine.values():
            whole.update(c)

        def share(c, kept=kept):
            below = sum(c[t] for t in kept) + 5 * len(kept)
            return [1 + 10**9 * (c[t] + 5) // below for t in kept]

        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        for s, c in mine.items():
            pairs = [(sum(abs(x - y) for x, y in zip(p[s], p[o])), o) for o in mine if o != s]
            terms = [(x - y, t) for x, y, t in zip(p[s], q, kept) if c[t] and x > y]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 50)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["The", "the", "of", "naïve", "Ünter", "日本", "x9y", "a-b", " z", "tie1", "tie2"] + [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    out = []
    for i in range(600):
        lang = rng.choice(["en", "en", "en", "de", None, "rare"]) if i % 50 else "lone"
        source = "hot" if rng.random() < 0.3 else rng.choice([None, "", *[f"s{k}" for k in range(12)]])
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        out.append((lang, source if lang != "lone" else "only", rng.choice([text, text, text, None, ""])))
    out += [("bare", "one", None), ("bare", "two", ""), ("bare", "three", "unheard")]
    return out + out[:20]


@pytest.mark.parametrize(("least", "slice_terms", "rounds"), [(30, dv.SLICE_TERMS, 8), (3, 7, 2), (1, 1, 1)])
def test_equals_plain(spark, rows, least, slice_terms, rounds):
    schema = "lang string, source string, text string, part string, rank string, seat int"
    df = spark.createDataFrame([(*r, "mine", "x", 1) for r in rows], schema).repartition(5)
    got = sorted(map(tuple, dv.divergence(df, least, slice_terms, rounds).collect()))
    assert got == plain(rows, least)


def test_small_tables(spark):
    schema = "lang string, source string, text string"
    assert dv.divergence(spark.createDataFrame([], schema)).count() == 0
    one = [("en", "a", "word")] * 40
    assert sorted(map(tuple, dv.divergence(spark.createDataFrame(one, schema)).collect())) == plain(one, 30) == []


def test_groups_stay_where_they_are(spark, rows):
    """Only the visitors are dealt; the seats' partitions are used as they lie."""
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    plan = dv.divergence(df)._jdf.queryExecution().toString()
    side = plan[plan.rindex("FlatMapCoGroupsInPandas") :].split("\n")[1:4]
    assert not any("Exchange" in line for line in side) and any("ExistingRDD" in line for line in side)


@pytest.mark.parametrize("seats", [2, 4, 6, 10, 32])
def test_tournament(seats):
    plan = dv.meetings(seats)
    assert sorted(tuple(sorted(m[1:])) for m in plan) == [(a, b) for a in range(seats) for b in range(a + 1, seats)]
    for r in range(1, seats):
        busy = [s for m in plan if m[0] == r for s in m[1:]]
        assert sorted(busy) == list(range(seats))


def test_vectors_and_probabilities_are_exact(monkeypatch):
    rng = random.Random(9)
    for _ in range(200):
        ids = np.array(sorted(rng.sample(range(5000), 20)))
        counts = np.array([rng.randrange(1, 10 ** rng.randint(1, 14)) for _ in ids])
        back = dv.unpacked(dv.packed(ids, counts))
        assert (back[0] == ids).all() and (back[1] == counts).all()
        total, kept = int(counts.sum()), rng.randint(20, 10**6)
        want = [1 + 10**9 * (int(c) + 5) // (total + 5 * kept) for c in counts]
        assert dv.probabilities(counts, total, kept).tolist() == want
    text = " ".join(f"Wort{i % 7} ÄB c" for i in range(500)).encode()
    whole = dv._terms(text)
    monkeypatch.setattr(dv, "PART_BYTES", 11)
    assert dv._terms(text) == whole
