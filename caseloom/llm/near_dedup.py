"""Near-duplicate documents by word shingles.

Method: SetSketch registers.  Each set of 5-word shingles becomes M registers, the exponents of
exponentially spaced, truncated minima of a Poisson process for each element: registers of a
union are the maxima, and equal registers are the more likely the more alike two sets are.
Bands of registers give candidate pairs, a joint likelihood over all registers and both set
sizes discards those far below the limit, and the rest is confirmed on the full sets.

Nothing is emitted for all pairs of a group:

* documents with equal sets are one class, whose smallest id stands for it;
* in a small bucket all pairs are candidates (at most SMALL_BUCKET a row);
* in a larger bucket every member is compared with the bucket's most connected member only;
* members of large buckets that this leaves in different components go through an exact pass
  over blocks: pairs of blocks of bounded size, sorted by set size so that blocks whose sizes
  exclude a link are skipped, return the edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import textcore
from caseloom.llm.components import components
from caseloom.llm.runtime import attach, durable

WIDTH = 5
#: Registers of a sketch, in bands of ROWS: two sets of similarity 0.8 meet in none of the 42
#: bands with probability 3e-6, two of similarity 0.3 meet in one with probability 0.03.
M, ROWS = 252, 6
#: Base of the exponents and their bound.
BASE, TOP = 1.02, 4000
SMALL_BUCKET = 32
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
#: Ids of documents to compare are broadcast up to this many (16 MB), joined beyond.
BROADCAST_IDS = 1_000_000


# --- sketches ---------------------------------------------------------------------------


def set_sketches(hashes: np.ndarray, offsets: np.ndarray, m: int = M) -> np.ndarray:
    """Registers (one row for each set) of sets of 64-bit hashes.

    The points of a Poisson process of rate m are drawn for each element in ascending order,
    each assigned to a register at random, so every register holds an independent exponential
    minimum.  Points beyond a bound that almost surely covers all minima of the set are not
    drawn; sets in which a register stays empty are drawn again with twice the bound.
    """
    n = np.diff(offsets)
    best = np.full((len(n), m), np.inf)
    todo = np.flatnonzero(n > 0)
    bound = (math.log(m) + 4.0) / np.maximum(n, 1)
    while len(todo):
        counts = n[todo]
        pick = np.concatenate([np.arange(offsets[t], offsets[t + 1]) for t in todo])
        owner = np.repeat(todo, counts)
        state, limit, at = hashes[pick], bound[owner], np.zeros(len(pick))
        flat = best.reshape(-1)
        step = 0
        while len(state):
            step += 1
            draw = textcore.mix64(state, step)
            unit = ((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
            at = at - np.log(unit) / m
            alive = at < limit
            state, owner, limit, at = state[alive], owner[alive], limit[alive], at[alive]
            register = textcore.mix64(draw[alive], 77) % np.uint64(m)
            np.minimum.at(flat, owner * m + register.astype(np.int64), at)
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        bound[todo] *= 2
    with np.errstate(divide="ignore"):
        values = np.floor(1.0 - np.log(best) / math.log(BASE))
    values[~np.isfinite(values)] = -TOP
    return np.clip(values, -TOP, TOP).astype(np.int16)


def band_keys(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band and set."""
    bands = registers.shape[1] // rows
    cut = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2]).copy()
    for r in range(rows):
        key = textcore.mix64(key * np.uint64(0x9FB21C651E98DF25) + cut[:, :, r], r + 1)
    return key.view(np.int64)


def similarity_likelihood(up: np.ndarray, down: np.ndarray, n_a, n_b, m: int = M) -> np.ndarray:
    """Jaccard estimate that maximises the joint likelihood of the registers.

    up, down: registers in which the first, the second sketch is larger.  With u, v the shares
    of the two sizes, a register differs upwards with probability p(u - v*J), downwards with
    p(v - u*J), where p(x) = -log_b(1 - x*(b - 1)/b).
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = m - up - down
    grid = np.linspace(0.0, 1.0, 201)
    top = np.minimum(u / v, v / u)
    best, arg = np.full(len(u), -np.inf), np.zeros(len(u))
    scale = (BASE - 1) / BASE
    for g in grid:
        j = g * top
        a = -np.log1p(-np.maximum(u - v * j, 1e-12) * scale) / math.log(BASE)
        b = -np.log1p(-np.maximum(v - u * j, 1e-12) * scale) / math.log(BASE)
        score = up * np.log(a) + down * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))
        better = score > best
        best[better], arg[better] = score[better], j[better]
    return arg


def _margin(limit: float, m: int = M) -> float:
    """Estimate below which a pair of similarity limit falls with probability under 1e-6."""
    return limit - 5.0 * math.sqrt(limit * (1 - limit) / m)


# --- stages -----------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in batch.column(1)]


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, registers, bands) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "set_a", "set_b", "registers", "bands"]
        for batch in textcore.slices(batches):
            texts = _texts(batch)
            for first, last, words, offsets, _ in textcore.batch_word_hashes(texts):
                hashes, at = textcore.shingles(words, offsets, WIDTH)
                regs = set_sketches(hashes, at)
                ends = np.concatenate([[np.uint64(0)], np.cumsum(textcore.mix64(hashes, 1))])
                more = np.concatenate([[np.uint64(0)], np.cumsum(textcore.mix64(hashes, 2))])
                keys = band_keys(regs)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(n.astype(np.int64)),
                        pa.array((ends[at[1:]] - ends[at[:-1]]).view(np.int64)),
                        pa.array((more[at[1:]] - more[at[:-1]]).view(np.int64)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]),
                            pa.array(keys.reshape(-1)),
                        ),
                    ],
                    names,
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        run,
        "doc_id long, n_shingles long, set_a long, set_b long, registers binary,"
        " bands array<long>",
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted distinct shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textcore.slices(batches):
            for first, last, words, offsets, _ in textcore.batch_word_hashes(_texts(batch)):
                hashes, at = textcore.shingles(words, offsets, WIDTH)
                sets = pa.ListArray.from_arrays(
                    pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), sets], ["doc_id", "shingles"]
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        run, "doc_id long, shingles array<long>"
    )


def _estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    out = np.zeros(len(a))
    for at in range(0, len(a), 2000):
        cut = slice(at, at + 2000)
        x = np.frombuffer(b"".join(a[cut]), np.int16).reshape(-1, M)
        y = np.frombuffer(b"".join(b[cut]), np.int16).reshape(-1, M)
        out[cut] = similarity_likelihood(
            (x > y).sum(1), (x < y).sum(1), n_a[cut].to_numpy(), n_b[cut].to_numpy()
        )
    return pd.Series(out)


def estimate_column(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    return F.pandas_udf(_estimate, "double")(a, b, n_a, n_b)


def _ratio(limit: float) -> tuple[int, int]:
    """limit as a fraction of whole numbers: 0.855 is 171/200, not 0.86."""
    exact = Fraction(str(limit))
    return exact.numerator, exact.denominator


def similar_links(sketches: DataFrame, docs: DataFrame, limit: float) -> DataFrame:
    """Links (a, b) that connect exactly what the links of similarity >= limit connect.

    sketches: one row for each distinct set (rep, n_shingles, registers, bands).
    """
    spark = docs.sparkSession
    keys = sketches.select("rep", F.explode("bands").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = durable(keys.join(sizes, "bucket"), 2)
    small = members.where(F.col("size") <= SMALL_BUCKET).select("bucket", "rep")
    pairs = (
        small.alias("x")
        .join(small.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    large = members.where(F.col("size") > SMALL_BUCKET)
    central = large.groupBy("rep").agg(F.sum("size").alias("weight"))
    ranked = durable(large.join(central, "rep").select("bucket", "rep", "weight"), 8)
    hubs = durable(
        ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub")), 8
    )
    # a large bucket may hold any share of the members: its hub goes to them where they are
    starred = (
        attach(ranked.select("bucket", "rep"), hubs, ["bucket"], "size")
        .where("rep != hub")
        .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        .distinct()
    )
    light = sketches.select("rep", "n_shingles", "registers")

    def side(name: str) -> DataFrame:
        return light.select(
            F.col("rep").alias(name),
            F.col("n_shingles").alias(f"n_{name}"),
            F.col("registers").alias(f"r_{name}"),
        )

    lowest = _margin(limit)
    up, down = _ratio(limit)
    candidates = durable(
        pairs.union(starred)
        .distinct()
        .join(side("a"), "a")
        .join(side("b"), "b")
        .where(down * F.least("n_a", "n_b") >= up * F.greatest("n_a", "n_b"))
        .withColumn("estimate", estimate_column(F.col("r_a"), F.col("r_b"), F.col("n_a"), F.col("n_b")))
        .where(F.col("estimate") >= lowest)
        .select("a", "b", "n_a", "n_b"),
        2,
    )
    wanted = durable(
        candidates.select(F.explode(F.array("a", "b")).alias("doc_id"))
        .union(ranked.select(F.col("rep").alias("doc_id")))
        .distinct(),
        8,
    )
    # ids alone are sent to all tasks while they are few, counted first; else the texts are dealt
    few = wanted.count() <= BROADCAST_IDS
    needed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(
        F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"
    )
    sets = durable(shingle_sets(needed))
    a, b = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    links = durable(
        candidates.join(a, "a").join(b, "b").withColumn("both", shared)
        .where(down * F.col("both") >= up * (F.col("n_a") + F.col("n_b") - F.col("both")))
        .select("a", "b")
        .distinct(),
        2,
    )
    if ranked.isEmpty():
        return links
    rest = _open_groups(ranked, links)
    return links.union(_block_links(rest, light, sets, limit, spark)) if rest is not None else links


def _open_groups(ranked: DataFrame, links: DataFrame) -> DataFrame | None:
    """(rep, component, grp) of members of large buckets that the links leave in several parts.

    component is the smallest document linked directly, enough to tell most linked members.
    Buckets that share members form one group, so no pair is compared once for each bucket.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    leads = both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("lead"))
    leads = leads.withColumn("lead", F.least("rep", "lead"))
    labelled = durable(
        ranked.select("bucket", "rep").join(leads, "rep", "left").withColumn("component", F.coalesce("lead", "rep")), 8
    )
    spread = durable(
        labelled.groupBy("bucket")
        .agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first"),
            F.count(F.lit(1)).alias("size"),
        )
        .where("lo != hi").select("bucket", "first", "size"), 8
    )
    tied = durable(attach(labelled, spread, ["bucket"], "size").select("rep", "first", "component"), 8)
    if tied.isEmpty():
        return None
    groups = components(tied.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    inside = tied.select("rep", "component").distinct()
    return inside.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "rep")


def _block_links(rest: DataFrame, light: DataFrame, sets: DataFrame, limit: float, spark) -> DataFrame:
    """Exact pass over the open groups: a spanning forest of the links between components.

    Members are dealt into size classes (log of the set size, one class spanning the limit) and
    within them by hash into blocks; a block meets the blocks of its own and of the next class.
    """
    ratio = _ratio(limit)
    lowest = _margin(limit)
    rows = rest.join(light, "rep").withColumn(
        "cls", F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(limit * 0.999)).cast("int")
    )
    sizes = rows.groupBy("grp", "cls").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
        ).cast("int").alias("blocks")
    )
    nxt = sizes.select("grp", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("up"))
    prev = sizes.select("grp", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("down"))
    plan = (
        rows.join(sizes, ["grp", "cls"]).join(nxt, ["grp", "cls"], "left").join(prev, ["grp", "cls"], "left")
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )

    def seq(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    same = F.transform(
        seq(F.col("blocks")),
        lambda o: F.struct(
            F.col("cls").alias("lo"), F.least(F.col("mine"), o).alias("i"), F.col("cls").alias("hi"),
            F.greatest(F.col("mine"), o).alias("j"), (F.lit(0)).alias("role"),
        ),
    )
    up = F.transform(
        seq(F.coalesce("up", F.lit(0))),
        lambda o: F.struct(
            F.col("cls").alias("lo"), F.col("mine").alias("i"), (F.col("cls") + 1).alias("hi"),
            o.alias("j"), F.lit(1).alias("role"),
        ),
    )
    down = F.transform(
        seq(F.coalesce("down", F.lit(0))),
        lambda o: F.struct(
            (F.col("cls") - 1).alias("lo"), o.alias("i"), F.col("cls").alias("hi"),
            F.col("mine").alias("j"), F.lit(2).alias("role"),
        ),
    )
    dealt = (
        plan.withColumn("t", F.explode(F.concat(same, up, down)))
        .select("grp", "t.lo", "t.i", "t.hi", "t.j", "t.role", "mine", "rep", "n_shingles", "component", "registers")
        .join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same_cls = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        if same_cls:
            left = pdf[pdf["mine"] == pdf["i"]]
            right = pdf[pdf["mine"] == pdf["j"]]
        else:
            left, right = pdf[pdf["role"] == 1], pdf[pdf["role"] == 2]
        return _forest(left, right, ratio, lowest)

    return dealt.groupBy("grp", "lo", "i", "hi", "j").applyInPandas(compare, "a long, b long")


def _forest(left: pd.DataFrame, right: pd.DataFrame, ratio: tuple[int, int], lowest: float) -> pd.DataFrame:
    """Links that join different components, each only where it joins two trees so far."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        regs = np.frombuffer(b"".join(right["registers"]), np.int16).reshape(-1, M)
        r_n, r_id = right["n_shingles"].to_numpy(), right["rep"].to_numpy()
        r_comp, r_sets = right["component"].to_numpy(), list(right["shingles"])
        for rep, n, comp, mine, own in zip(
            left["rep"], left["n_shingles"], left["component"], left["registers"], left["shingles"], strict=True
        ):
            fits = (r_comp != comp) & (ratio[1] * np.minimum(r_n, n) >= ratio[0] * np.maximum(r_n, n))
            if not fits.any():
                continue
            at = np.flatnonzero(fits)
            x = np.frombuffer(mine, np.int16)
            up, down = (x > regs[at]).sum(1), (x < regs[at]).sum(1)
            # cheap necessary condition first: equal registers are at least those of the limit
            at = at[similarity_likelihood(up, down, np.full(len(at), n), r_n[at]) >= lowest]
            for k in at.tolist():
                other = int(r_comp[k])
                if root(int(comp)) == root(other):
                    continue
                both = len(np.intersect1d(own, r_sets[k], assume_unique=True))
                if ratio[1] * both >= ratio[0] * (n + r_n[k] - both):
                    parent[root(int(comp))] = root(other)
                    found.append((int(rep), int(r_id[k])))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame, limit: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs with an id.

    Links join documents whose shingle sets have |both| >= limit * |either|, compared exactly.  A text with
    fewer than five words has one shingle of all its words; a null text or one without words
    has none, links with nothing and is kept.  Rows that share an id are one document: its links
    are those of all its texts, and each row gets its component.  Rows with a null id are kept with a null component and never linked.
    An empty table gives an empty result; other columns are not read.
    """
    sketches = durable(sketch_documents(docs))
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    keys = ["set_a", "set_b", "n_shingles"]
    classes = durable(filled.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), 4)
    distinct = filled.join(
        classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi"
    ).dropDuplicates(["doc_id", "set_a", "set_b"]).select(F.col("doc_id").alias("rep"), "n_shingles", "registers", "bands")
    links = similar_links(durable(distinct), docs, limit)
    found = components(links).select(F.col("node").alias("rep"), "component")
    labelled = durable(
        classes.join(found, "rep", "left")
        .select(*keys, "copies", F.coalesce("component", "rep").alias("component")), 4
    )
    # copies of one text may be any share of the rows; sets without shingles have no class
    out = attach(sketches.select("doc_id", *keys), labelled, keys, how="left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
