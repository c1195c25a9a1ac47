"""Periodic runs of words in texts, and texts with the repeats taken out.

A run is a stretch of words with smallest period q, at least max(LEAST_WORDS, LEAST_TURNS * q)
long, that no neighbouring word extends.

Method: the root of a run is, at one of its places, the longest Lyndon word that starts there
under one of the two orders of the words.  The texts' words are scanned from right to left with a
stack of the next smaller suffixes, once for each order; suffixes are compared, and periods
extended to both sides, by longest common extensions: a binary search on rolling hashes, whose
answer is verified word by word.  No suffix array is made.  Words are numbered exactly, so
equal numbers are equal words.

Verified extensions are kept by distance: the scan meets the same distance again one period
further left, verifies only the words between, and so reads each word a bounded number of times.

Every word of a run lies in three words in a row that occur three times in the text.  Stretches of
words for which this does not hold have no run and are not scanned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.textcore import slices

LEAST_WORDS, LEAST_TURNS = 6, 4
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that can hold a run: covered by three words in a row that occur three times."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    # numbers below 2**21 are packed exactly; larger ones may share a key, which only adds ranges
    keys = (ids[:-2] << 42) ^ (ids[1:-1] << 21) ^ ids[2:]
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    often = np.zeros(len(keys) + 2, dtype=np.int8)
    often[order] = np.repeat(size >= 3, size)
    covered = np.zeros(n + 2, dtype=np.int8)
    covered[1:-1] = often | np.roll(often, 1) | np.roll(often, 2)  # the last two are never a start
    edge = np.diff(covered)
    spans = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
    return [(a, b) for a, b in spans if b - a >= LEAST_WORDS]


class Extensions:
    """Longest common extensions of pairs of places in a sequence of numbers."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids.tolist()
        self.n = len(ids)
        power = np.full(self.n + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum((spread ^ (spread >> np.uint64(29))) * power[: self.n], out=sums[1:])
        self._power, self._sums = power.tolist(), sums.tolist()
        self._known: dict[int, tuple[int, int]] = {}  # distance -> a verified range of left places

    def _agree(self, i: int, j: int, size: int) -> bool:
        s = self._sums
        return (s[i + size] - s[i]) * self._power[j - i] & _MASK == s[j + size] - s[j] & _MASK

    def _search(self, i: int, j: int, most: int) -> int:
        """Words from i and j on that agree, at most `most`."""
        size = 1
        while size < most and self._agree(i, j, min(2 * size, most)):
            size = min(2 * size, most)
        low, high = (size, min(2 * size, most)) if size < most else (most, most)
        if size == 1 and not self._agree(i, j, 1):
            return 0
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._agree(i, j, middle) else (low, middle - 1)
        return low

    def _verified(self, i: int, j: int, size: int) -> int:
        """The number of words that do agree, of `size` that hashes say agree."""
        ids = self.ids
        if ids[i : i + size] == ids[j : j + size]:
            return size
        return next(k for k in range(size) if ids[i + k] != ids[j + k])

    def right(self, i: int, j: int) -> int:
        """Equal words from i and j on, i < j."""
        ids, most = self.ids, self.n - j
        if not most or ids[i] != ids[j]:
            return 0
        start, end = self._known.get(j - i, (0, 0))
        if start <= i < end:
            return end - i
        gap = start - i
        if 0 < gap < most and end > start:
            size = self._search(i, j, gap)
            size = self._verified(i, j, size)
            if size == gap:
                self._known[j - i] = (i, end)
                return end - i
        else:
            size = self._verified(i, j, self._search(i, j, most))
        self._known[j - i] = (i, i + size)
        return size

    def left(self, i: int, j: int) -> int:
        """Equal words that end before i and j, i < j: a binary search on the same hashes."""
        ids, low, high = self.ids, 0, i
        if not i or ids[i - 1] != ids[j - 1]:
            return 0
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._agree(i - middle, j - middle, middle) else (low, middle - 1)
        if ids[i - low : i] == ids[j - low : j]:
            return low
        return next(k for k in range(low) if ids[i - 1 - k] != ids[j - 1 - k])


def lyndon_ends(ext: Extensions, sign: int) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there, the place of the next
    smaller suffix; sign is 1 or -1 for the two orders of the numbers."""
    ids, n = ext.ids, ext.n
    ends = [n] * n
    stack = [n]  # from the top: next smaller suffix of the place on the right, and so on
    for i in range(n - 1, -1, -1):
        own = ids[i]
        while True:
            j = stack[-1]
            if j == n:
                break  # the empty suffix is smaller than any
            if own == ids[j]:
                size = ext.right(i, j)
                if j + size == n or (ids[j + size] - ids[i + size]) * sign < 0:
                    break
            elif (ids[j] - own) * sign < 0:
                break
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return ends


def _runs_within(ids: np.ndarray) -> set[Run]:
    found: set[Run] = set()
    ext = Extensions(ids)
    for sign in (1, -1):
        covered: dict[int, int] = {}  # period -> end of its last run, places ascending
        ends = np.asarray(lyndon_ends(ext, sign))
        place = np.flatnonzero(ends < len(ids))
        place = place[ids[place] == ids[ends[place]]]
        for i, j in zip(place.tolist(), ends[place].tolist(), strict=True):
            period = j - i
            if i < covered.get(period, 0):
                continue
            size = ext.right(i, j)
            if size < period:  # the first root of a run of LEAST_TURNS turns is followed by another
                continue
            start, end = i - ext.left(i, j), j + size
            # a later place before end - period has the same period and so the same run
            covered[period] = end - period
            if end - start >= max(LEAST_WORDS, LEAST_TURNS * period):
                found.add((start, end - start, period))
    return found


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a sequence of numbers, by start, then period."""
    found: set[Run] = set()
    for a, b in stretches(ids):
        found |= {(a + s, size, q) for s, size, q in _runs_within(ids[a:b])}
    return sorted(found)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each of n words stays: those of a run after its first period go."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, size, period in runs:
        change[start + period] += 1
        change[start + size] -= 1
    return np.cumsum(change)[:n] == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, exactly; ties: smallest start, then period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def drilled(words: list[bytes], doc_id) -> list[bytes]:
    """The words, for a tenth of the ids with a periodic end made from them."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _each(docs: DataFrame, make, schema: str) -> DataFrame:
    """Rows that make(id, text in bytes) gives for each row's id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            rows = [r for i, t in zip(ids, texts, strict=True) for r in make(i, t.as_py() or b"")]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    full = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}"
    fields = StructType.fromDDL(full).fields
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]
    return rows.mapInArrow(run, full)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period), one row for each run of each row's whole text, in words
    from 0.  Null, empty and short texts have none; repeated rows give their runs each; an empty
    table gives no row; other columns are not read."""
    make = lambda i, t: [(i, *r) for r in find_runs(numbered(t.split()))]
    return _each(docs, make, "start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """docs with the words of each run after its first period taken out of text.

    A text without runs stays as it is, white space included; a changed one has single blanks.
    Null texts stay null, repeated rows are changed alike, all rows and columns stay, and an
    empty table gives no row.
    """
    place = docs.columns.index("text")

    def cut(text: bytes | None) -> bytes | None:
        words = (text or b"").split()
        runs = find_runs(numbered(words))
        if not runs:
            return text
        return b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([cut(t.as_py()) for t in batch.column(place).cast(pa.binary())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], texts, *batch.columns[place + 1 :]], batch.schema.names)

    kinds = [(n, "string" if n == "text" else t) for n, t in docs.dtypes]
    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kinds))


def run_digests(docs: DataFrame) -> DataFrame:
    """For each row, of its words as drilled() gives them: doc_id, n_runs, the strongest run's
    start, length, period and exponent_milli, runs_sha256, collapsed_sha256.

    A null or empty text has no words, no run and the digests of nothing; a null id is never
    drilled; repeated rows give one row each; an empty table gives none.
    """

    def make(doc_id, text: bytes) -> list[tuple]:
        words = drilled(text.split(), doc_id)
        runs = find_runs(numbered(words))
        best = strongest(runs)
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()
        left = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))] if runs else words
        about = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return [(doc_id, len(runs), *about, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())]

    return _each(
        docs, make, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    )
