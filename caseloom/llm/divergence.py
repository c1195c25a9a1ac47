"""How the sources of a language differ in the words they use.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.  A language keeps the
terms that LEAST_DOCS of its documents hold.  Each source of a language is a group; a group and
the language itself give each kept term a probability, in billionths, with PRIOR added to its
count.  Two groups diverge by the sum of the differences over all kept terms.

Method: systolic rotation.  A language's terms are cut into slices and its groups dealt to seats.
Each group's counts of a slice are one compressed vector that stays in the partition of its seat;
copies of the vectors circulate: the seats play a round-robin tournament (circle method), in each
round of which every seat meets another one, and one of the two is host to the vectors of the
other and evaluates both directions of the meeting.  In the first round the groups of a seat meet
each other and the vector of their language, against which heaps rank the terms of each group
where it sits.  Partial sums and heaps of the slices are then merged.

Memory is bounded: a task holds the vectors of one seat and the visitors of ROUNDS_AT_ONCE rounds,
each of at most about SLICE_TERMS terms; seats have about the square root of the number of groups.
The driver learns two numbers, the most terms and the most groups of a language.

Counts are added up in each task before they are dealt, so no term has more rows than tasks times
groups, whatever its share of the words.  All arithmetic is in whole numbers.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.llm.runtime import durable, partitions
from caseloom.llm.textcore import slices

LEAST_DOCS, PRIOR, BILLION, TOP_TERMS = 30, 5, 10**9, 50
SLICE_TERMS, ROUNDS_AT_ONCE = 1 << 12, 8
#: Distinct terms that a task adds up before it hands them on.
HELD_TERMS = 1 << 19
#: Bytes of words of one text that are split at a time.
PART_BYTES = 1 << 22
#: Bytes to blanks where they are no part of a term, A-Z to a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> Counter:
    """Counts of the terms of a text, taken part by part."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = at + PART_BYTES
        while stop < len(text) and _FOLD[text[stop]] != 32:
            stop += 1
        found.update(text[at:stop].translate(_FOLD).split())
        at = stop
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), added up within tasks: n occurrences of term in docs
    documents.  Each document also counts once for the empty term, so that every group has a row."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = ["lang", "source", "term", "n", "docs"]

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_of) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            columns = [pa.array([v] * len(n), pa.string()) for v in (lang, source)]
            columns += [terms, pa.array(list(n.values()), pa.int64()), pa.array(list(docs_of.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in slices(batches):
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                own = _terms(text.as_py())
                own[b""] = 1
                size -= len(n)
                for term, k in own.items():
                    n[term] += k
                    docs_of[term] += 1
                size += len(n)
                if size > HELD_TERMS:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A compressed vector: ascending numbers of terms, by their gaps, and their counts."""
    gaps = np.diff(ids, prepend=0).astype("<u4")
    wide = bool(len(counts)) and int(counts.max()) >> 32 > 0
    return bytes([wide]) + zlib.compress(gaps.tobytes() + counts.astype("<u8" if wide else "<u4").tobytes(), 1)


def unpacked(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not vector:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = zlib.decompress(vector[1:])
    n = len(raw) // (12 if vector[0] else 8)
    ids = np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))
    return ids, np.frombuffer(raw, "<u8" if vector[0] else "<u4", n, 4 * n).astype(np.int64)


def probabilities(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(BILLION * (count + PRIOR) / (total + PRIOR * kept)), by long division in base
    1,000: exact for totals up to 9e15."""
    below = total + PRIOR * kept
    result, rest = np.divmod(counts + PRIOR, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        result = result * 1000 + more
    return 1 + result


def dense(vector: bytes | None, total: int, kept: int, width: int) -> np.ndarray:
    """The probabilities of all terms of a slice."""
    ids, counts = unpacked(vector)
    every = np.zeros(width, np.int64)
    every[ids] = counts
    return probabilities(every, total, kept)


def meetings(seats: int) -> list[tuple[int, int, int]]:
    """(round, host, visitor) of a round-robin tournament of an even number of seats, rounds from
    1: each two seats meet once, and no seat has two meetings in a round."""
    out = []
    for r in range(1, seats):
        circle = [0, *((k + r) % (seats - 1) + 1 for k in range(seats - 1))]
        for k in range(seats // 2):
            a, b = sorted((circle[k], circle[seats - 1 - k]))
            out.append((r, a, b) if (a + b) % 2 else (r, b, a))
    return out


def _resident(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, kept in the shared folder in partitions by keys, sorted by them.  Spark knows of these
    partitions later on and moves only what is joined to them.  An adaptive plan does not tell how
    its result is dealt, so this one step runs without."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return durable(df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys))
    finally:
        conf.set(name, before)


FOUND = "lang string, source string, part string, item string, value long"


def _meet(key: tuple, seated: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
    """Results of one seat and slice: its groups with the visitors of some rounds.

    Visitors without a source are the vector of the language, with the names of its terms; it
    comes with each set of rounds, for the width of the slice; `opening` marks the first set.
    """
    out: list[tuple] = []
    if not len(seated):
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])
    visiting = visiting.rename(columns=lambda c: c.removeprefix("guest_"))
    lang, kept = key[0], int(seated["kept"].iloc[0])
    own = visiting[visiting["terms"].notna()]
    width = own["terms"].iloc[0].count("\n") + 1 if len(own) else 0
    names = seated["source"].tolist()
    here = [dense(v, int(n), kept, width) for v, n in zip(seated["vector"], seated["total"], strict=True)] if width else []

    def pair(a: str, b: str, value: int) -> None:
        out.append((lang, a, "pair", b, value))
        out.append((lang, b, "pair", a, value))

    if seated["opening"].iloc[0]:
        for i, a in enumerate(names):
            for j in range(i):
                pair(a, names[j], int(np.abs(here[i] - here[j]).sum()) if width else 0)
        if width:
            terms = own["terms"].iloc[0].split("\n")
            q = dense(own["vector"].iloc[0], int(own["total"].iloc[0]), kept, width)
            for a, p, vector in zip(names, here, seated["vector"], strict=True):
                ids, _ = unpacked(vector)
                more = (p - q)[ids]
                ids, more = ids[more > 0], more[more > 0]
                # terms are numbered in the order of their names, so equal values go by number
                best = heapq.nsmallest(TOP_TERMS, zip((-more).tolist(), ids.tolist(), strict=True))
                out += [(lang, a, "term", terms[i], -v) for v, i in best]
    guests = visiting[visiting["terms"].isna()]
    for b, n, vector in zip(guests["source"], guests["total"], guests["vector"], strict=True):
        there = dense(vector, int(n), kept, width) if width else None
        for a, p in zip(names, here or names, strict=True):
            pair(a, b, int(np.abs(p - there).sum()) if width else 0)
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, slice_terms: int = SLICE_TERMS, rounds: int = ROUNDS_AT_ONCE) -> DataFrame:
    """(lang, source, part, item, value, rank) of the groups (lang, source) of docs.

    part pair: every other source of the language with its divergence, 0 where the language keeps
    no term.  part term: the TOP_TERMS kept terms that the group uses more than its language.
    Ranks from 1 by value descending, then item in the order of its bytes.  Null text, lang and
    source count as ''; empty texts have no terms but make their group occur; repeated rows count
    each; an empty table gives no row, nor has a language's only source a pair; other columns are
    not read.
    """
    term, group = ["lang", "term"], ["lang", "source"]
    # one exchange by term serves the sum of each group and that of the language
    summed = (
        term_counts(docs).repartition(*term).groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("in_docs", F.sum("docs").over(Window.partitionBy(*term)))
    )
    counts = durable(
        summed.where((F.col("in_docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "source", "n")
    )
    kept = counts.where("term != ''")
    vocabulary = kept.groupBy(*term).agg(F.sum("n").alias("n"))
    languages = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total"))
    groups = durable(
        counts.groupBy(*group).agg(F.sum(F.when(F.col("term") != "", F.col("n")).otherwise(0)).alias("total"))
        .join(languages.select("lang", "kept"), "lang", "left").fillna(0, ["kept"]), 4
    )
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).agg(F.max("n"), F.max("kept")).first()
    n_slices = max(1, -(-(most[1] or 0) // slice_terms))
    seats = max(2, math.isqrt(max((most[0] or 1) - 1, 0)) + 1)
    seats += seats % 2

    sliced = F.pmod(F.xxhash64("term"), F.lit(n_slices)).cast("int")
    number = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1
    numbers = durable(vocabulary.withColumn("slice", sliced).withColumn("id", number), 4)

    def vector(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        made = packed(rows["id"].to_numpy(), rows["n"].to_numpy())
        named = "\n".join(rows["term"]) if "term" in rows else None
        return pd.DataFrame([(*key, made, named)], columns=[*vector_keys, "vector", "terms"])

    vector_keys = ["lang", "source", "slice"]
    schema = "lang string, source string, slice int, vector binary, terms string"
    numbered = kept.join(numbers.select("lang", "term", "slice", "id"), term).select("lang", "source", "slice", "id", "n")
    vectors = numbered.groupBy(*vector_keys).applyInPandas(vector, schema).drop("terms")
    of_languages = (
        numbers.withColumn("source", F.lit("")).select("lang", "source", "slice", "id", "n", "term")
        .groupBy(*vector_keys).applyInPandas(vector, schema).join(languages, "lang")
        .select("lang", "slice", F.lit(None).cast("string").alias("source"), "total", "kept", "vector", "terms")
    )
    every = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    place = ["lang", "slice", "seat"]
    seated = _resident(
        every.join(vectors, vector_keys, "left").withColumn("seat", F.pmod(F.xxhash64("source"), F.lit(seats)).cast("int")), place
    )
    of_languages = durable(of_languages.withColumn("seat", F.explode(F.sequence(F.lit(0), F.lit(seats - 1)))))
    plan = meetings(seats)
    sets = range(1, seats, rounds)
    found = None
    for first in sets:
        ahead = docs.sparkSession.createDataFrame(
            [(host, visitor) for r, host, visitor in plan if first <= r < first + rounds], "host int, seat int"
        )
        # a row a meeting of these rounds, at most rounds times half the seats
        moved = seated.join(F.broadcast(ahead), "seat").withColumn("seat", F.col("host"))
        columns = [*place, "source", "total", "kept", "vector"]
        visitors = moved.select(*columns, F.lit(None).cast("string").alias("terms")).unionByName(of_languages.select(*columns, "terms"))
        visitors = visitors.toDF(*[f"guest_{c}" for c in visitors.columns])
        part = (
            seated.withColumn("opening", F.lit(first == 1)).groupBy(*place)
            .cogroup(visitors.groupBy(*[f"guest_{c}" for c in place])).applyInPandas(_meet, FOUND)
        )
        part = durable(part, 4) if len(sets) > 1 else part  # a lost executor then costs one set of rounds
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy(*group, "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy(*group, "part").orderBy(F.desc("value"), "item")
    ranked = merged.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
