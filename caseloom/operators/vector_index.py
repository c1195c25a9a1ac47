"""An index of vectors on disk: an inverted file of cells with residual codes and exact re-scoring.

Unit vectors are dealt to the cells of a spherical k-means, which is fitted on a bounded sample.
The index is a folder of three Parquet tables:

* cells: each cell's centre, the number of its vectors, and the cosine of its widest vector;
* codes: a folder a cell, with each vector's id and its residual to the centre in eight bits;
* vectors: a folder a cell, with each vector in full.

A search reads the folders of some cells only.  search() probes the nearest cells of each query by
their codes and scores the best of them again by the full vectors, read where they lie.
exact_search() leaves out only cells that cannot hold a better vector than those found: for unit
vectors, the angle to a cell's centre less the cell's widest angle bounds the similarity.

Queries travel to the tasks, QUERIES_AT_ONCE at a time; each task keeps the best rows of each, so
what is moved is bounded by tasks x queries x n.  A cell of many vectors, such as copies of one, has
many files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.retrieval import _top, _unit, slices_of
from caseloom.operators.topn import BLOCK_SCORES, Best, best_rows, ids_of
from caseloom.session import durable

#: Cells: about the square root of the number of vectors, at most so many; sampled vectors for each
#: cell, and bytes of the whole sample, which is gathered to fit the centres.
MOST_CELLS, SAMPLE_OF_CELL, SAMPLE_BYTES = 8_192, 32, 256 << 20
ROUNDS = 8
#: Rows of one file of a cell.
FILE_ROWS = 100_000
#: Queries that travel to the tasks together.
QUERIES_AT_ONCE = 10_000
#: Candidates by codes that are scored again, for each wanted row.
REFINE = 8
#: Cosines are compared with this much room for rounding.
ROOM = 1e-6


def _centres(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centres of a spherical k-means: starts drawn in proportion to the distance to those before;
    an empty cell takes the vector that fits its own worst."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]
    while len(chosen) < cells:
        weight = np.maximum(1 - near, 0)
        if weight.sum() < 1e-9:
            break  # fewer different vectors than cells
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(ROUNDS):
        own, fit = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        for k in np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0):
            worst = int(fit.argmin())
            sums[k], fit[worst] = x[worst], np.inf
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its cosine."""
    own, fit = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, BLOCK_SCORES // max(1, len(centres)))
    for at in range(0, len(x), step):
        score = x[at : at + step] @ centres.T
        own[at : at + step] = score.argmax(axis=1)
        fit[at : at + step] = score.max(axis=1)
    return own, fit


def build(vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
    """Write an index of vectors(id, embedding) to path.

    Null vectors, those with a null, non-finite or zero norm, and those of another length than
    most are not indexed, as no search by cosine can find them.  cells: by default about the
    square root of the number of vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, n = (widths[0][0], widths[0][1]) if widths else (1, 0)
    rows = rows.where(F.size("embedding") == width)
    wanted = max(1, min(cells or math.isqrt(n), MOST_CELLS))
    sampled = max(1, min(SAMPLE_OF_CELL * wanted, SAMPLE_BYTES // (8 * max(width, 1))))
    sample = rows.orderBy(F.xxhash64("embedding"), "id").limit(sampled).select("embedding").toArrow()
    x, good = _unit(sample["embedding"].combine_chunks(), width)
    x = x[good]
    centres = _centres(x, min(wanted, len(x))) if len(x) else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            unit, known = _unit(batch.column(1), width)
            keep = pa.array(np.flatnonzero(known))
            unit = unit[known]
            own, fit = _nearest(unit, middle)
            rest = unit - middle[own]
            scale = np.maximum(np.abs(rest).max(axis=1, initial=0), 1e-12)
            code = np.round(rest / scale[:, None] * 127).astype(np.int8)
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * width, pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), flat, pa.array(own, pa.int32()), pa.array(fit), codes, pa.array(scale / 127)],
                ["id", "unit", "cell", "fit", "code", "scale"],
            )

    dealt = durable(
        rows.mapInArrow(assign, f"id {rows.schema['id'].dataType.simpleString()}, unit array<double>, cell int, fit double, code binary, scale double")
    )
    about = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fit").alias("least")).collect()  # a row a cell
    table = [(r["cell"], centres[r["cell"]].tolist(), r["n"], r["least"]) for r in sorted(about)]
    spark.createDataFrame(table, "cell int, centre array<double>, n long, least double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    files = spark.createDataFrame([(r["cell"], -(-r["n"] // FILE_ROWS)) for r in about], "cell int, files long")
    spread = (
        dealt.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("id"), "files"))
        .repartition("cell", "file").sortWithinPartitions("cell", "id")
    )
    for name, columns in (("codes", ["id", "code", "scale"]), ("vectors", ["id", "unit"])):
        spread.select("cell", *columns).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{name}")
    return VectorIndex(spark, path)


@dataclass
class VectorIndex:
    """An index that build() wrote."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").toArrow()  # at most MOST_CELLS
        self.cells = rows["cell"].to_numpy()
        self.width = len(rows["centre"][0]) if len(rows) else 1
        self.centres = np.array(rows["centre"].to_pylist() or np.zeros((0, 1)))
        self.least = rows["least"].to_numpy()
        self.sizes = rows["n"].to_numpy()

    def table(self, name: str, cells: np.ndarray) -> DataFrame:
        """Rows of the given cells; the folders of others are not read."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("cell").isin([int(c) for c in cells]))

    # --- searches -----------------------------------------------------------------------

    def _slices(self, queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Ids and unit vectors of the queries with a vector, about QUERIES_AT_ONCE at a time."""
        asked = queries.select("query_id", F.col("query_embedding").cast("array<double>").alias("v")).where(F.size("v") == self.width)
        for part in slices_of(asked, "query_id", QUERIES_AT_ONCE):
            rows = part.toArrow()
            unit, good = _unit(rows["v"].combine_chunks(), self.width)
            if good.any():
                yield rows["query_id"].combine_chunks().filter(pa.array(good)), unit[good]

    def _scored(self, names: pa.Array, unit: np.ndarray, asks: np.ndarray, n: int) -> DataFrame:
        """(query_id, id, similarity): the n best of each query in the cells that asks, a matrix of
        queries by cells, names, by full vectors."""
        used = np.flatnonzero(asks.any(axis=0))
        number = {int(self.cells[k]): k for k in used}

        def fill(best: Best, batch: pa.RecordBatch) -> None:
            for cell in pc.unique(batch.column(2)).to_pylist():
                part = batch.filter(pc.equal(batch.column(2), cell))
                asking = np.flatnonzero(asks[:, number[cell]])
                x, _ = _unit(part.column(1), unit.shape[1])
                ids = ids_of(part.column(0))
                for at in range(0, len(x), max(1, BLOCK_SCORES // len(asking))):
                    block = slice(at, at + max(1, BLOCK_SCORES // len(asking)))
                    _add(best, asking, ids[block], np.round(unit[asking] @ x[block].T, 9))

        rows = self.table("vectors", self.cells[used]).select("id", "unit", "cell")
        return best_rows(rows, names, "similarity", n, "double", fill)

    def exact_search(self, queries: DataFrame, n: int, probe: int = 4) -> DataFrame:
        """(query_id, id, similarity, rank): the n nearest vectors of each query, all of them.

        The nearest `probe` cells tell how good the n-th is at least; then those other cells are
        read that may hold a better one.
        """
        found = None
        for names, unit in self._slices(queries):
            near, bound = self._probed(unit, probe), self._bounds(unit)
            first = durable(_top(self._scored(names, unit, near, n), n, F.desc("similarity"), F.asc("id")).drop("rank"))
            last = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).toArrow()
            reached = np.full(len(names), -np.inf)  # a number a query
            place = pc.index_in(last["query_id"], names).to_numpy()
            reached[place] = np.where(last["n"].to_numpy() >= n, last["least"].to_numpy(), -np.inf)
            more = ~near & (bound >= reached[:, None] - ROOM)
            rows = first.unionByName(self._scored(names, unit, more, n)) if more.any() else first
            found = rows if found is None else found.unionByName(rows)
        return self._ranked(found, queries, n)

    def search(self, queries: DataFrame, n: int, probe: int = 16) -> DataFrame:
        """(query_id, id, similarity, rank): the n nearest vectors found in `probe` cells.

        Codes choose REFINE * n vectors of each query, which are scored by their full vectors.
        """
        found = None
        for names, unit in self._slices(queries):
            asks = self._probed(unit, probe)
            number = {int(c): k for k, c in enumerate(self.cells)}
            base = unit @ self.centres.T

            def fill(best: Best, batch: pa.RecordBatch, asks=asks, number=number, base=base, unit=unit) -> None:
                for cell in pc.unique(batch.column(3)).to_pylist():
                    part = batch.filter(pc.equal(batch.column(3), cell))
                    k = number[cell]
                    asking = np.flatnonzero(asks[:, k])
                    raw = b"".join(part.column(1).to_pylist())
                    code = np.frombuffer(raw, np.int8).reshape(len(part), -1) * part.column(2).to_numpy()[:, None]
                    _add(best, asking, ids_of(part.column(0)), base[asking, k][:, None] + unit[asking] @ code.T)

            used = self.cells[asks.any(axis=0)]
            rows = self.table("codes", used).select("id", "code", "scale", "cell")
            close = best_rows(rows, names, "about", REFINE * n, "double", fill)
            close = _top(close, REFINE * n, F.desc("about"), F.asc("id")).select("query_id", "id")
            # the queries of a slice, at most QUERIES_AT_ONCE; candidates are REFINE * n for each
            asked = self.spark.createDataFrame(
                pa.table([names, pa.array(unit.tolist(), pa.list_(pa.float64()))], ["query_id", "asked"])
            )
            full = self.table("vectors", used).join(close, "id").join(F.broadcast(asked), "query_id")
            score = F.aggregate(F.zip_with("unit", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            part = full.select("query_id", "id", F.round(score, 9).alias("similarity"))
            found = part if found is None else found.unionByName(part)
        return self._ranked(found, queries, n)

    def _probed(self, unit: np.ndarray, probe: int) -> np.ndarray:
        """Queries by cells: whether a cell is one of the nearest `probe` of the query."""
        score = unit @ self.centres.T
        asks = np.zeros(score.shape, bool)
        if score.size:
            near = np.argsort(-score, axis=1, kind="stable")[:, :probe]
            np.put_along_axis(asks, near, True, axis=1)
        return asks

    def _bounds(self, unit: np.ndarray) -> np.ndarray:
        """Queries by cells: no vector of the cell has a greater cosine with the query."""
        apart = np.arccos(np.clip(unit @ self.centres.T, -1, 1))
        return np.cos(np.maximum(apart - np.arccos(np.clip(self.least, -1, 1)), 0))

    def _ranked(self, found: DataFrame | None, queries: DataFrame, n: int) -> DataFrame:
        if found is None:  # no query with a vector, or no vector
            kind = self.spark.read.parquet(f"{self.path}/vectors").schema["id"].dataType if len(self.cells) else "long"
            found = queries.select("query_id", F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("similarity")).limit(0)
        return _top(found, n, F.desc("similarity"), F.asc("id"))


def _add(best: Best, asking: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Add scores of the asking queries (rows) and ids (columns)."""
    query, row = np.nonzero(scores >= best.least[asking][:, None])
    best.add(asking[query], ids[row], scores[query, row])
