"""Connected components of a link table, without gathering links on the driver.

Alternating large-star and small-star steps: each node's larger neighbours are hooked to its
smallest one, then each node's smaller neighbours are.  Both steps are a grouped minimum (with
map-side combining, so a hub with many links is no hot key) and a join that Spark may split.
Rounds grow with the logarithm of the longest chain.  Each round is kept in the shared folder.

A table of at most ONE_TASK_LINKS distinct links, counted first, is solved by one executor task
in bounded memory instead: rounds of shuffles would cost more than the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.runtime import durable


ONE_TASK_LINKS = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node that each one reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        # hook the roots of both ends, then follow the labels to their ends
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return nodes, nodes[label]


def _one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if len(x)]
        if parts:
            node, root = smallest_reachable(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "component"])

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(
        run, "node long, component long"
    )


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component) for every node in links(a, b); component is the smallest node id.

    Self links, repeated and reversed links change nothing.  Links with a null end are left
    out.  An empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null and a != b")
    links = durable(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 8
    )
    before = _digest(links)
    if before[0] <= one_task:
        return _one_task(links)
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    )
                ).alias("e")
            )
            .select("e.a", "e.b")
            .where("a != b")
            .distinct()
        )
        links = durable(small)
        after = _digest(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
