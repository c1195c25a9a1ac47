"""Packing documents into token sequences of a fixed length.

Method: best-fit decreasing.  Each document is encoded and closed by an end id; its full
windows become sequences of their own, and its rest is placed, longest first, in the open
window with the least room that still holds it.  A segment tree over the remaining capacity
finds that window in log(length) steps.

Each document has one last piece, so a group of documents has as many to pack as it has rows,
whatever their lengths.  Last pieces are dealt into groups of about GROUP_PIECES by their row
number, each packed by one task: no task grows with the table and no key can be hot.  A group
leaves a handful of windows short of full.  Full windows are sequences as they are and are never
shuffled.

Documents that have an order are dealt by consecutive ranges of it instead, and sequences are
numbered in it, so that what the order decides holds for the sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.runtime import durable
from caseloom.llm.textcore import slices
from caseloom.llm.tokens import encode_pieces, encoder

GROUP_PIECES = 16_384
#: Numbers of sequences in the order of positions: the group, the place in it, then a flag and a
#: number that tell the sequences of one place apart; a full window has no flag and the number of
#: windows before it in its document.
GROUP_SHIFT, PLACE_SHIFT, FLAG = 40, 24, 1 << 23
#: Without positions full windows have the number of their row, the others this bit and a number.
PACKED = 1 << 62


class CapacityTree:
    """Segment tree over capacities 0..top; each leaf is a stack of open windows."""

    def __init__(self, top: int) -> None:
        self.width = 1 << top.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(self.width)]

    def push(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.width
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """Least capacity >= need with an open window; -1 if there is none."""
        node = need + self.width
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return -1

    def pop(self, capacity: int) -> int:
        node = capacity + self.width
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; lengths are in 1..window, in any order."""
    order = np.argsort(-lengths, kind="stable")
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(window), 0
    for i in order.tolist():
        need = int(lengths[i])
        room = tree.tightest(need) if need < window else -1
        if room < 0:
            number[i], opened, room = opened, opened + 1, window
        else:
            number[i] = tree.pop(room)
        offset[i] = window - room
        if room > need:
            tree.push(room - need, int(number[i]))
    return number, offset


def pieces(
    docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, position: str | None = None
) -> DataFrame:
    """Full windows and the last piece of each document: (doc_id, start, length, ids_crc32,
    doc_tokens, last), and pack_position, where the column of that number is given."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            owner, start, length, crc, total = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                parts = list(encode_pieces(enc, text.as_py() or ""))
                ids = np.concatenate([*parts, [end_id]]).astype("<u4")
                view, n = memoryview(ids), len(ids)
                for at in range(0, n, window):
                    owner.append(row)
                    start.append(at)
                    length.append(min(window, n - at))
                    crc.append(zlib.crc32(view[at : at + window]))
                    total.append(n)
            last = [s + k == t for s, k, t in zip(start, length, total, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int32()))]
                + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                + [pa.array(last, pa.bool_())]
                + [c.take(pa.array(owner, pa.int32())) for c in batch.columns[2:]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "last", *batch.schema.names[2:]],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = [docs[position].cast("long").alias("pack_position")] if position else []
    return docs.select(docs["doc_id"], docs["text"].cast("string"), *placed).mapInArrow(
        cut,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, last boolean"
        + (", pack_position long" if position else ""),
    )


def sequence_numbers(number: np.ndarray, position: np.ndarray, group: int, group_pieces: int) -> np.ndarray:
    """Numbers of the windows that hold the pieces: by the mean place of their pieces, with a
    count of those before at the same place."""
    mean = np.floor(np.bincount(number, weights=position - group * group_pieces) / np.bincount(number))
    order = np.argsort(mean, kind="stable")
    sorted_mean = mean[order].astype(np.int64)
    tie = np.arange(len(order)) - np.searchsorted(sorted_mean, sorted_mean)
    made = np.empty(len(order), np.int64)
    made[order] = (group << GROUP_SHIFT) + (sorted_mean << PLACE_SHIFT) + FLAG + tie
    return made[number]


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 1024,
    end_id: int = 0,
    group_pieces: int = GROUP_PIECES,
    position: str | None = None,
) -> DataFrame:
    """Pieces of all documents with their place: adds sequence_id and offset.

    Each id lies in exactly one piece, and the pieces of a sequence follow each other without a
    gap from offset 0.  A null text is empty and gives one piece, the end id.  doc_id may be of
    any type, null and repeated: it is only carried.  Repeated rows are packed one by one; equal
    lengths keep the order of the rows; an empty table gives no piece; columns other than doc_id
    and text are not read.

    position: a column that numbers all rows from 0.  Groups are then consecutive ranges of it,
    and sequence_id rises with it: with the ranges, and in each with the mean position of a
    sequence's pieces.  Without it rows are numbered as they come.
    """
    cut = durable(pieces(docs, tokenizer, window, end_id, position))  # some 60 bytes a piece
    cut = cut.withColumn("pack_row", F.monotonically_increasing_id())
    if position:
        group = F.floor(F.col("pack_position") / group_pieces).cast("long")
        place = F.col("pack_position") % group_pieces
        whole = F.shiftleft(group, GROUP_SHIFT) + F.shiftleft(place, PLACE_SHIFT) + F.floor(F.col("start") / window)
    else:
        groups = max(1, -(-cut.where("last").count() // group_pieces))
        group = F.pmod(F.xxhash64("pack_row"), F.lit(groups)).cast("long")
        whole = F.col("pack_row")
    order = "pack_position" if position else "pack_row"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place_pieces(key: tuple, found: pa.Table) -> pa.Table:
        at = found["pack_order"].to_numpy()
        rows = np.argsort(at, kind="stable")
        found, at, group = found.take(pa.array(rows)), at[rows], key[0].as_py()
        number, offset = best_fit_decreasing(found["length"].to_numpy(), window)
        ids = sequence_numbers(number, at, group, group_pieces) if position else PACKED + (group << 23) + number
        return pa.table([*(found[n] for n in names), pa.array(ids), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = (
        cut.where("last")
        .select(*names, F.col(order).alias("pack_order"), group.alias("pack_group"))
        .groupBy("pack_group")
        .applyInArrow(
            place_pieces,
            f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )
    full = cut.where("not last").select(*names, whole.cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
