from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from caseloom.operators import enrichment


def plain(rows, n, least):
    rows = [r for r in rows if r[1] is not None and len(r[1]) >= least]
    tf = {}
    for i, text in rows:
        tf.setdefault(i, Counter()).update(re.findall(r"\w{3,}", text.lower()))
    df = Counter(t for c in tf.values() for t in c)
    best = {i: sorted(c, key=lambda t: (-round(c[t] * math.log(len(rows) / df[t]), 9), t))[:n] for i, c in tf.items()}
    return {i: k for i, k in best.items() if k}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = [f"w{k:03d}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randint(1, 80))) + f" only{i}") for i in range(300)]
    # ids that repeat, ids and texts that are null, short texts and texts without tokens
    return [*rows, *[(i, f"w000 again again{i} w299 w299 w299") for i in range(0, 40, 3)], (None, "nobody has this id here"), (None, "nobody again w001"), (900, None), (901, "short"), (902, "a b c d e f g h i j k l m")]


@pytest.mark.parametrize("most", [0, 5, 40, 1 << 17])
def test_keywords_equal_a_plain_count(spark, texts, monkeypatch, most):
    """Whatever number of frequencies goes to all tasks."""
    monkeypatch.setattr(enrichment, "MOST_TOKENS", most)
    df = spark.createDataFrame(texts, "id long, content string").repartition(5)
    assert {r["id"]: r["keywords"] for r in enrichment.keywords(df, 4).collect()} == plain(texts, 4, 20)


def test_only_tokens_that_may_be_best_are_shuffled(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{k:03d}" for k in range(150)) + f" best{i % 50} " * 3 + f" x{rng.randint(0, 90):03d}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, content string").repartition(2).localCheckpoint()

    def moved():
        jvm = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    got = {r["id"]: r["keywords"] for r in enrichment.keywords(df, 2).collect()}
    # 400 texts of 152 tokens were shuffled as 60,800 rows, three times
    assert got == plain(rows, 2, 20) and moved() - before < 10_000
