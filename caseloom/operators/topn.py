"""The best rows of many queries, kept within each task.

A task holds the best n rows of each query so far and lets go of all others, so what leaves it is
bounded by queries times n, whatever the number of rows it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Scores of one block of rows, queries times rows, and scores held before they are cut to the best.
BLOCK_SCORES, MOST_HELD = 1 << 21, 1 << 20


class Best:
    """The n best (score, then smallest id) rows of each of `queries` queries."""

    def __init__(self, queries: int, n: int) -> None:
        self.n = n
        self.least = np.full(queries, -np.inf)  # a row below it is none of the query's best
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least[query]
        self.parts.append((query[keep], ids[keep], score[keep]))
        self.held += len(self.parts[-1][0])
        if self.held > MOST_HELD:
            self.cut()

    def add_block(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: queries times rows; -inf for a row that is none of the query's."""
        query, row = np.nonzero((scores >= self.least[:, None]) & (scores > -np.inf))
        self.add(query, ids[row], scores[query, row])
        if np.isinf(self.least).any():
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.n - 1
        self.least[query[full]] = score[full]
        keep = place < self.n
        self.parts = [(query[keep], ids[keep], score[keep])]
        self.held = len(self.parts[0][0])
        return self.parts[0]


def best_rows(
    rows: DataFrame, queries: pa.Array, score: str, n: int, kind: str, fill: Callable[[Best, pa.RecordBatch], None]
) -> DataFrame:
    """(query_id, id, <score>): each task's n best rows for each query.

    rows: a table whose first column is id.  queries: their ids.  fill adds a batch to the best.
    """
    names = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), n)
        kept = None
        for batch in batches:
            kept = batch.schema.field(0).type
            fill(best, batch)
        if kept is None:
            return
        query, ids, found = best.cut()
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(query, pa.int64())), pa.array(ids, kept), pa.array(found).cast(pa.int64() if kind == "long" else pa.float64())],
            ["query_id", "id", score],
        )

    return rows.mapInArrow(run, f"query_id {_type(names)}, id {rows.dtypes[0][1]}, {score} {kind}")


def _type(names: pa.Array) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(names.type).simpleString()


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)
