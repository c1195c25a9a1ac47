"""Vectorised word and shingle hashing shared by the text operators.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), with A-Z
lower-cased and every other byte kept.  A prefix-sum polynomial hash gives all word hashes of a
buffer in a few numpy passes, so no Python code runs per word.  Buffers are cut on white space
into segments of bounded size: memory does not grow with the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: For classification: letters and digits only, every byte of a multi-byte character included.
_IS_ALNUM = np.zeros(256, dtype=bool)
_IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Rows of an Arrow batch that are held as Python texts at a time.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches; memory freed by large ones goes back to the system, as
    a worker may stay idle for long."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        if len(_POWERS) > 2:
            _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)

        def series(b: int) -> np.ndarray:
            a = np.full(size, b & _MASK, dtype=np.uint64)
            a[0] = 1
            return np.multiply.accumulate(a)

        _POWERS[size] = series(_BASE), series(inverse)
    return _POWERS[size]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix64(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(52)))


def word_spans(text: bytes, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with the starts and ends of their words."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = (_IS_ALNUM if alnum else _IS_WORD)[raw]
    edge = np.diff(inside)
    return _LOWER[raw], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes, prefix: int = 0, alnum: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of the words of one text; with prefix, also of each word's first bytes."""
    whole: list[np.ndarray] = []
    heads: list[np.ndarray] = []
    for part in _segments(text):
        data, starts, ends = word_spans(part, alnum)
        whole.append(_hash_spans(data, starts, ends))
        if prefix:
            heads.append(_hash_spans(data, starts, np.minimum(ends, starts + prefix)))
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate(whole or [empty]), np.concatenate(heads or [empty]) if prefix else None


def _segments(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > 2 * SEGMENT_BYTES:
        cut = at + SEGMENT_BYTES
        while cut < len(text) and _IS_WORD[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def batch_word_hashes(
    texts: list[bytes], prefix: int = 0, alnum: bool = False
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Yield (first, last, words, offsets, heads) for runs of texts of about SEGMENT_BYTES.

    words holds the hashes of all words of texts[first:last] in order; the words of text
    first + i are words[offsets[i]:offsets[i + 1]].
    """
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SEGMENT_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        if stop == at + 1:
            whole, heads = word_hashes(texts[at], prefix, alnum)
            yield at, stop, whole, np.array([0, len(whole)]), heads
        else:
            data, starts, ends = word_spans(b"\n".join(texts[at:stop]), alnum)
            whole = _hash_spans(data, starts, ends)
            heads = _hash_spans(data, starts, np.minimum(ends, starts + prefix)) if prefix else None
            limits = np.cumsum([0] + [len(t) + 1 for t in texts[at:stop]])
            yield at, stop, whole, np.searchsorted(starts, limits), heads
        at = stop


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, with offsets.

    A text with fewer than width words has one shingle of all its words; one without words has
    none.
    """
    n_words = np.diff(offsets)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    step = np.uint64(0xD6E8FEB86659FD93)
    rolled = words.copy()
    for k in range(1, width):
        rolled *= step
        if k < len(words):
            rolled[:-k] += words[k:]
    owner = np.repeat(np.arange(len(n_words)), n_words)
    left = np.repeat(offsets[1:], n_words) - np.arange(len(words))
    keep = left >= width
    hashes, owners = mix64(rolled[keep], 5), owner[keep]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        extra = np.empty(len(short), dtype=np.uint64)
        for i, d in enumerate(short):
            acc = int(n_words[d])
            for w in words[offsets[d] : offsets[d + 1]]:
                acc = (acc * 0xD6E8FEB86659FD93 + int(w)) & _MASK
            extra[i] = acc
        hashes = np.concatenate([hashes, mix64(extra, 6)])
        owners = np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(len(n_words) + 1))
