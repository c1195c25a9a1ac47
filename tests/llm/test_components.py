from __future__ import annotations

import random

import pytest

from caseloom.llm.components import components


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_equal_union_find(spark, one_task):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    links += [(500, 500 + i) for i in range(1, 30)] + links[:3] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, one_task=one_task).collect()}
    assert got == brute([x for x in links if x[0] != x[1]])


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
