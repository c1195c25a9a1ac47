"""Near-duplicate embeddings by a pivot-permutation index.

Method: each vector is described by its NEAREST nearest reference points (pivots) in order.
Inverted lists from pivots to vectors retrieve candidates: within a list the pivots that two
vectors share are counted, those that share at least SHARED are candidates, and only these are
verified by their cosine in double precision.  A pair is a candidate in the list of the first
pivot it shares only.

Pivots are chosen farthest first from a bounded sample of the vectors, so that they do not crowd
inside a large group of near vectors, whose members would then share few of them; every vector
is indexed.  Equal vectors of a label
are one class, so a very common vector is one entry.  Lists longer than BLOCK entries are cut
into blocks and compared block by block, so no list is one task.  A block returns, for each
vector, the number of vectors linked and one edge to the smallest linked tree: its rows grow
with the vectors, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.components import components
from caseloom.llm.runtime import attach, durable

#: Pivots: one for each VECTORS_PER_PIVOT distinct vectors, within these bounds.
VECTORS_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 32, 2048
NEAREST, SHARED = 10, 2
#: Pivots are chosen from so many times as many vectors; beyond LEAST_PIVOTS, none whose cosine
#: with a chosen one reaches SPACING.
SAMPLED, SPACING = 4, 0.8
BLOCK = 1024


def _lists(column: pa.ListArray | pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """Matrix of the lists in rows, which have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = (column if len(rows) == len(column) else column.take(pa.array(rows))).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _lengths(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.list_value_length(column), dtype=np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Rows of sample, unit vectors, farthest first: each has the least cosine with those before."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(wanted, len(sample)):
        nearest[chosen[-1]] = np.inf
        at = int(np.argmin(nearest))
        if nearest[at] >= SPACING and len(chosen) >= LEAST_PIVOTS:
            break
        chosen.append(at)
        np.maximum(nearest, sample @ sample[at], out=nearest)
    return sample[chosen]


def choose_pivots(vectors: DataFrame, most: int = MOST_PIVOTS) -> np.ndarray:
    """Spread vectors of a sample of the distinct ones, drawn by a hash of their id; at most `most` rows."""
    n = vectors.count()
    wanted = min(most, max(LEAST_PIVOTS, n // VECTORS_PER_PIVOT))
    sampled, parts = SAMPLED * wanted, 1_000_000
    # a share of the rows by another hash first, so that the sort is not over the whole table
    share = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(parts)) < min(parts, 2 * sampled * parts // max(n, 1) + 1)
    drawn = vectors.where(share).select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sampled)
    rows = [v.values.to_numpy(zero_copy_only=False) for v in drawn.toArrow().column("embedding")]
    if not rows:
        return np.zeros((0, 0))
    widths = [len(v) for v in rows]
    width = max(set(widths), key=widths.count)
    found = np.array([v for v in rows if len(v) == width], dtype=np.float64)
    return spread_pivots(found / np.linalg.norm(found, axis=1, keepdims=True), wanted)


def describe(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """vectors with `pivots`, the ordered numbers of each one's nearest reference points."""
    if not len(pivots):
        return vectors.limit(0).withColumn("pivots", F.array().cast("array<int>"))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        k = min(nearest, len(base))
        for batch in batches:
            near = np.zeros((len(batch), k), dtype=np.int32)
            column = batch.column("embedding")
            fits = np.flatnonzero(_lengths(column) == base.shape[1])
            for at in range(0, len(fits), 4096):
                rows = fits[at : at + 4096]
                cos = _unit(_lists(column, rows)) @ base.T
                best = np.sort(np.argpartition(-cos, k - 1, axis=1)[:, :k], axis=1)
                order = np.argsort(-np.take_along_axis(cos, best, axis=1), axis=1, kind="stable")
                near[rows] = np.take_along_axis(best, order, axis=1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * k), pa.array(near.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "pivots"])

    return vectors.mapInArrow(
        run, ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes) + ", pivots array<int>"
    )


def _compare(key: tuple, found: pa.Table, limit: float, shared: int) -> pa.Table:
    """Links of one list, or of two of its blocks: (rep, linked, tree) for each vector linked."""
    pivot, i, j = (k.as_py() for k in key[1:])
    mine, sizes = found["mine"].to_numpy(), _lengths(found["embedding"])
    out = []
    for size in np.unique(sizes):  # vectors of different lengths have no cosine
        left = np.flatnonzero((sizes == size) & (mine == i))
        right = left if i == j else np.flatnonzero((sizes == size) & (mine == j))
        if len(left) and len(right):
            out.append(_links(found, left, right, i == j, pivot, limit, shared))
    made = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("rep", "linked", "tree"), map(pa.array, made), strict=True)))


def _candidates(p: np.ndarray, q: np.ndarray, one_block: bool, pivot: int, shared: int) -> np.ndarray:
    """Which pairs share at least `shared` pivots, none of them numbered below `pivot`."""
    names, flat = np.unique(np.concatenate([p.reshape(-1), q.reshape(-1)]), return_inverse=True)
    has_p = np.zeros((len(p), len(names)), np.float32)
    has_q = np.zeros((len(q), len(names)), np.float32)
    np.add.at(has_p, (np.repeat(np.arange(len(p)), p.shape[1]), flat[: p.size]), 1)
    has_q[np.repeat(np.arange(len(q)), q.shape[1]), flat[p.size :]] = 1
    both = has_p @ has_q.T >= min(shared, p.shape[1])
    lower = names < pivot
    if lower.any():
        both &= has_p[:, lower] @ has_q[:, lower].T == 0
    return np.triu(both, 1) if one_block else both


def _links(found: pa.Table, left, right, one_block, pivot, limit, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = _candidates(_lists(found["pivots"], left), _lists(found["pivots"], right), one_block, pivot, shared)
    # only vectors that have a candidate are read and verified
    r, c = np.flatnonzero(both.any(axis=1)), np.flatnonzero(both.any(axis=0))
    left, right = left[r], right[c]
    if not len(left):
        return (np.zeros(0, np.int64),) * 3
    cos = _unit(_lists(found["embedding"], left)) @ _unit(_lists(found["embedding"], right)).T
    rows, cols = np.nonzero(both[np.ix_(r, c)] & (cos >= limit))
    reps, copies = found["rep"].to_numpy(), found["copies"].to_numpy()
    a, b = reps[left][rows], reps[right][cols]
    ends = np.concatenate([a, b])
    names, at = np.unique(ends, return_inverse=True)
    linked = np.bincount(at, np.concatenate([copies[right][cols], copies[left][rows]]), len(names)).astype(np.int64)
    # a forest keeps the vectors of this block connected
    return names, linked, _smallest(names, at[: len(a)], at[len(a) :])


def _smallest(names: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """The smallest of names (ascending) that the links ia-ib reach from each."""
    label = np.arange(len(names))
    while len(ia):
        before = label.copy()
        low = np.minimum(label[ia], label[ib])
        np.minimum.at(label, ia, low)
        np.minimum.at(label, ib, low)
        label = label[label]
        if (label == before).all():
            break
    return names[label]


def near_duplicates(vectors: DataFrame, limit: float = 0.93, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label).

    Links join vectors of equal labels with cosine >= limit.  A vector that is null, empty or
    zero, holds null or non-finite components, or has a null label or id links with nothing
    and is kept, as its own component.  Repeated rows and equal vectors are each counted; an
    empty table gives no row; other columns are not read.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"),
        vectors["embedding"].cast(kind).alias("embedding"),
        vectors["label"].alias("label"),
    )
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    )
    keyed = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = durable(
        keyed.where("usable").groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    index = describe(classes, choose_pivots(classes))
    # vectors of another length than the pivots have pivot 0 only, and are compared in its list
    entries = index.withColumn("pivot", F.explode(F.array_distinct("pivots")))
    lists = entries.select("label", "pivot").groupBy("label", "pivot").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    )
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        entries.join(lists, ["label", "pivot"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "label", "pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
            "mine", "rep", "copies", "embedding", "pivots",
        )
    )
    found = durable(
        dealt.groupBy("label", "pivot", "i", "j").applyInArrow(
            lambda key, found: _compare(key, found, limit, shared), "rep long, linked long, tree long"
        )
    )
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("tree").alias("b")))
    labelled = durable(
        classes.join(linked, "rep", "left")
        .join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(
            "label", "embedding", "copies",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    # copies of one vector may be any share of the rows
    good = attach(keyed.where("usable"), labelled, ["label", "embedding"]).select(
        "vec_id", "n_links", F.col("component").alias("component_id")
    )
    rest = keyed.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return good.unionByName(rest).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
