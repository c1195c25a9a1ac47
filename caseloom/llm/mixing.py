"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of BLOCK_DOCS rows, whatever the size of the table.  With weight w,
the j-th block of a source is released at slot floor((j - 1) / w) and due by slot ceil(j / w); of
the released blocks the one with the earliest deadline runs.  As the weights sum to 1, every
deadline is met, and after any number of slots each source is less than one block away from its
share.  When a source has no block left, the weights of the others are scaled to 1 and their
windows start anew, a new phase: nothing is dropped or repeated.

Weights are whole parts.  After as many slots as there are parts in all, every source has run
exactly its parts and the schedule repeats, so the driver computes one period of each phase and
the slot of any block follows in closed form: a few numbers a phase and one row for each slot of
a period, at most PLAN_SLOTS in all or LEAST_PARTS a source, however large the table.  Rows are placed by joins with
these and never gathered.

Up to MOST_SOURCES sources, the largest, are scheduled one by one.  Further ones are dealt by
their names into GROUPS groups, each scheduled as one source with the weights of its members.

Ordinals within a source are counted over hash buckets of about BUCKET_DOCS rows, as many as the
source's size asks for, so that a source with a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.llm.runtime import BROADCAST_ROWS, partitions

BLOCK_DOCS = 32
MOST_SOURCES, GROUPS = 512, 64
BUCKET_DOCS = 2_000
#: Weights are rounded to so many parts, at least one for each source; the parts become fewer where
#: there are many sources, so that the periods of all phases have about PLAN_SLOTS slots.
MOST_PARTS, LEAST_PARTS, PLAN_SLOTS = 1 << 16, 1 << 12, 1 << 20
#: Default target: shares in proportion to the number of documents to this power.
POWER = 0.5
#: Columns that mix() makes.
ADDED = frozenset(
    "mix_source mix_block mix_slot mix_phase mix_position mix_bucket mix_buckets mix_n mix_rank mix_before mix_in mix_row"
    " mix_ordinal mix_phases mix_now mix_turn mix_at".split()
)


def integer_weights(weights: dict) -> dict:
    """Weights as whole parts."""
    total = sum(weights.values())
    most = min(MOST_PARTS, max(LEAST_PARTS, PLAN_SLOTS // max(len(weights), 1)))
    return {s: max(1, round(most * w / total)) for s, w in weights.items()}


@dataclass
class Phase:
    """A stretch of the schedule in which the same sources have blocks left.

    period[k] is the number in `sources` of the source that runs in slot k, k + len(period), ...;
    first holds each source's blocks before the phase, slots the length, start the slot it begins at.
    """

    sources: list
    parts: list[int]
    first: list[int]
    period: np.ndarray
    slots: int
    start: int


def _period(parts: list[int], most: int) -> np.ndarray:
    """Sources by slot under earliest-deadline-first, for one period or `most` slots.

    Equal deadlines go to the larger weight, then to the source that comes first.
    """
    total = sum(parts)
    done = [0] * len(parts)
    order = np.empty(min(total, most), np.int32)
    ready: list[tuple[int, int, int]] = []
    waiting = [(0, i) for i in range(len(parts))]  # released, source
    for slot in range(len(order)):
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * total // parts[i]), -parts[i], i))
        i = heapq.heappop(ready)[2]
        order[slot] = i
        done[i] += 1
        heapq.heappush(waiting, (done[i] * total // parts[i], i))
    return order


def schedule(blocks: dict, weights: dict) -> list[Phase]:
    """The phases for blocks, the number of blocks of each source."""
    parts = integer_weights(weights)
    left = {s: n for s, n in sorted(blocks.items(), key=lambda x: str(x[0])) if n > 0}
    done = dict.fromkeys(left, 0)
    phases: list[Phase] = []
    start = 0
    while left:
        sources = list(left)
        mine = [parts[s] for s in sources]
        total = sum(mine)
        order = _period(mine, sum(left.values()))
        turns = [np.flatnonzero(order == i) for i in range(len(sources))]

        def last_slot(i: int, n: int, turns=turns, mine=mine, total=total) -> int:
            return (n - 1) // mine[i] * total + int(turns[i][(n - 1) % mine[i]])

        # the phase ends with the first last block of a source; those it is too short for end later
        ends = [last_slot(i, n) for i, n in enumerate(left.values()) if (n - 1) % mine[i] < len(turns[i])]
        slots = min(ends) + 1
        phases.append(Phase(sources, mine, [done[s] for s in sources], order, slots, start))
        rounds, more = divmod(slots, total)
        for i, s in enumerate(sources):
            ran = rounds * mine[i] + int(np.searchsorted(turns[i], more))
            done[s] += ran
            left[s] -= ran
        left = {s: n for s, n in left.items() if n > 0}
        start += slots
    return phases


def edf_order(blocks: dict, weights: dict) -> list[tuple[object, int, int]]:
    """(source, block, phase) by slot, written out; blocks' numbers start at 0."""
    order = []
    for number, p in enumerate(schedule(blocks, weights)):
        done = list(p.first)
        for k in range(p.slots):
            i = int(p.period[k % sum(p.parts)])
            order.append((p.sources[i], done[i], number))
            done[i] += 1
    return order


def _plan(spark, phases: list[Phase], sizes: dict, block: int) -> tuple[DataFrame, DataFrame]:
    """The schedule as two tables: (mix_source, mix_phases), the phases of each source in order, and
    (mix_source, mix_now, mix_turn, mix_at), the slot of each turn within a period."""
    by_source: dict = {}
    names, owner, now, turn, at = [], [], [], [], []
    rows = 0
    for number, p in enumerate(phases):
        total = sum(p.parts)
        period = p.period[: p.slots]
        for i, s in enumerate(p.sources):
            by_source.setdefault(s, []).append((number, p.first[i], p.parts[i], total, p.start, rows))
            slots = np.flatnonzero(period == i)
            owner.append(np.full(len(slots), len(names), np.int32))
            names.append(s)
            now.append(np.full(len(slots), number, np.int32))
            turn.append(np.arange(len(slots)))
            at.append(slots)
        # only the last slot of a phase can hold a block that is not full
        ended = p.sources[int(p.period[(p.slots - 1) % total])]
        rows += p.slots * block - (-sizes[ended] % block)
    phase = "struct<number:int,first:long,parts:long,total:long,start:long,rows:long>"
    starts = spark.createDataFrame(list(by_source.items()), f"mix_source string, mix_phases array<{phase}>")
    schema = "mix_source string, mix_now int, mix_turn long, mix_at long"
    if not names:
        return starts, spark.createDataFrame([], schema)
    owners = pa.DictionaryArray.from_arrays(np.concatenate(owner), pa.array(names, pa.string())).dictionary_decode()
    columns = [owners, *(np.concatenate(x) for x in (now, turn, at))]
    made = spark.createDataFrame(pa.table(columns, ["mix_source", "mix_now", "mix_turn", "mix_at"]), schema)
    # sources times phases, and the slots of the periods
    return F.broadcast(starts), F.broadcast(made) if len(owners) <= BROADCAST_ROWS else made


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    block_docs: int = BLOCK_DOCS,
    power: float = POWER,
    most_sources: int = MOST_SOURCES,
    in_order: bool = False,
) -> DataFrame:
    """docs with mix_source, mix_block, mix_slot, mix_phase and mix_position.

    mix_position numbers all rows from 0 in the mixed order.  weights: target share of each
    source; by default shares follow the number of documents to the given power.  A source that
    weights leave out gets the smallest given weight.  A null source is a source of its own,
    ''.  Repeated rows are scheduled one by one; rows of one id follow each other by text, or in
    any order where docs has no text; null ids come as any other id; empty and long texts are only
    carried; an empty table gives no row.  Columns of these names in docs are replaced.
    in_order: rows come in partitions by ranges of the position, each sorted by it.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*kept).withColumn("mix_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    counts = rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"))
    largest = [(r[0], r[1]) for r in counts.orderBy(F.desc("n"), "mix_source").limit(most_sources + 1).collect()]
    size = dict(largest[:most_sources])
    share = lambda s, n: weights.get(s, min(weights.values())) if weights else n**power
    target = {s: share(s, n) for s, n in size.items()}
    if len(largest) > most_sources:
        named = spark.createDataFrame([(s, s) for s in size], "mix_source string, mix_own string")
        group = F.concat(F.lit("\u0000group-"), F.pmod(F.xxhash64("mix_source"), F.lit(GROUPS)).cast("string"))
        grouped = lambda df: df.join(F.broadcast(named), "mix_source", "left").withColumn(
            "mix_source", F.coalesce("mix_own", group)
        ).drop("mix_own")
        if weights:
            given = spark.createDataFrame([(str(s), float(w)) for s, w in weights.items()], "mix_source string, w double")
            counts = counts.join(given, "mix_source", "left").withColumn("w", F.coalesce("w", F.lit(float(min(weights.values())))))
        else:
            counts = counts.withColumn("w", F.col("n") ** power)
        rows = grouped(rows)
        counts = grouped(counts).groupBy("mix_source").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        for r in counts.collect():  # at most most_sources + GROUPS rows
            size[r["mix_source"]] = r["n"]
            target[r["mix_source"]] = r["w"]
    spread = spark.createDataFrame(
        [(s, -(-n // BUCKET_DOCS)) for s, n in size.items()], "mix_source string, mix_buckets long"
    )
    rows = (
        rows.join(F.broadcast(spread), "mix_source")  # a row a source
        .withColumn("mix_n", F.xxhash64("doc_id"))
        .withColumn("mix_bucket", F.pmod("mix_n", "mix_buckets"))
        .drop("mix_buckets")
    )
    counts = rows.groupBy("mix_source", "mix_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "mix_source", "mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before")
    )
    within = Window.partitionBy("mix_source", "mix_bucket").orderBy(
        "mix_n", F.col("doc_id"), *([F.col("text")] if "text" in kept else [])
    )
    phases = schedule({s: -(-n // block_docs) for s, n in size.items()}, target)
    starts, turns = _plan(spark, phases, size, block_docs)
    numbered = rows.withColumn("mix_rank", F.row_number().over(within) - 1).join(
        offsets, ["mix_source", "mix_bucket"]
    )
    ordinal = F.col("mix_rank") + F.col("mix_before")
    now = F.element_at(F.filter("mix_phases", lambda p: p["first"] <= F.col("mix_block")), -1)
    gone = F.col("mix_block") - F.col("mix_row.first")
    within_phase = F.floor(gone / F.col("mix_row.parts")).cast("long") * F.col("mix_row.total") + F.col("mix_at")
    placed = (
        numbered.withColumn("mix_block", F.floor(ordinal / block_docs).cast("long"))
        .withColumn("mix_in", (ordinal % block_docs).cast("long"))
        .join(starts, "mix_source")
        .withColumn("mix_row", now)
        .withColumn("mix_now", F.col("mix_row.number"))
        .withColumn("mix_turn", gone % F.col("mix_row.parts"))
        .join(turns, ["mix_source", "mix_now", "mix_turn"])
    )
    out = placed.select(
        *kept, "mix_source", "mix_block",
        (F.col("mix_row.start") + within_phase).alias("mix_slot"),
        F.col("mix_now").cast("long").alias("mix_phase"),
        (F.col("mix_row.rows") + within_phase * block_docs + F.col("mix_in")).alias("mix_position"),
    )
    if not in_order:
        return out
    # positions have no gaps, so their ranges need no sample
    n, total = partitions(spark), max(1, sum(size.values()))
    return out.repartitionById(n, F.floor(F.col("mix_position") * n / total).cast("int")).sortWithinPartitions("mix_position")


def mixed_documents(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs, all rows and columns, in the mixed order: partitions by ranges of the position,
    each sorted by it, so that files written from it follow the schedule."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ADDED}
    out = mix(docs.withColumnsRenamed(own), weights, block_docs, in_order=True)
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def file_positions(docs: DataFrame, name: str) -> DataFrame:
    """docs read from files, with the column name: numbers of all rows from 0 in the order of the
    files' names and of the rows in them, which is that of a written mixed_documents()."""
    spark = docs.sparkSession
    rows = docs.select(
        *docs.columns, F.col("_metadata.file_name").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_row")
    )
    sizes = docs.select(F.col("_metadata.file_name").alias("file")).groupBy("file").count().collect()
    at, table = 0, []
    for file, n in sorted(map(tuple, sizes)):
        table.append((file, at))
        at += n
    starts = spark.createDataFrame(table, f"{name}_file string, {name}_start long")
    return rows.join(F.broadcast(starts), f"{name}_file").select(  # one row a file
        *docs.columns, (F.col(f"{name}_start") + F.col(f"{name}_row")).alias(name)
    )
