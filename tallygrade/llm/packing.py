"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Best-fit decreasing looks only at lengths, of which there are as many as a sequence
is long. So the lengths of all pieces are counted, the packing of these counts is
worked out on the driver, whatever the number of documents, and every piece finds its
place by its rank among the pieces of its length. The packing is that of taking the
documents one by one, longest first, each into the tightest open bin; pieces of equal
length, which follow each other there, are taken as one run of alike steps.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrade.llm.texts import slices
from tallygrade.llm.tokens import SLICE_BYTES, encoded, load, with_end
from tallygrade.session import cut

CAPACITY = 2048
RANKS = 1 << 50


class Capacities:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, room: int, first: int, count: int) -> None:
        """Open `count` bins, numbered from `first`, with `room` left each."""
        self.bins[room].append((first, count))
        self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.bins[room].pop()

    def _count(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that takes `length`."""
        at = length + self.leaves
        while not self.open[at]:
            while at & 1:  # a right child: its parent ends where it ends
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces to a bin, offset in the bin) that pack the counted lengths."""
    tree, runs, bins = Capacities(capacity), [], 0
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = room // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                each = room // length  # after one piece the same bin is the tightest for the next
                first, count = tree.take(room)
            runs.append((length, rank, first, each, capacity - room))
            full = min(count, left // each)
            if full:
                tree.add(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < count and left:
                tree.add(room - left * length, first + full, 1)
                rank, full, left = rank + left, full + 1, 0
            if full < count:
                tree.add(room, first + full, count - full)
    return runs


def pieces(documents: DataFrame, vocabulary: str, end: int, capacity: int) -> DataFrame:
    """Every document's pieces of at most `capacity` ids, with their number among the task's pieces of that length."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for some in slices(batches, "text", SLICE_BYTES):
            ids, counts = with_end(*encoded(tokenizer, some.column("text"), spaces=False), end)
            raw = memoryview(ids.astype("<u4").tobytes())
            n_pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(counts[owner] - start, capacity)
            begins = (np.cumsum(counts) - counts)[owner] + start
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), length.tolist())), np.int64, len(owner))
            order = np.argsort(length, kind="stable")
            nth = np.empty(len(owner), np.int64)
            same = length[order]
            nth[order] = np.arange(len(owner)) - np.searchsorted(same, same) + seen[same]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.record_batch(
                [
                    some.column("doc_id").cast(pa.int64()).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc), pa.array(np.full(len(owner), part, np.int32)), pa.array(nth),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return documents.select("doc_id", "text").mapInArrow(made, kinds)


def best_fit_packing(documents: DataFrame, vocabulary: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Where every piece of every document (doc_id, text) lies in sequences of `capacity` ids.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its ids
    and the end id, so null and empty texts have length 1. Only longer documents are
    cut. Rows with null or equal doc_id are documents of their own; which of several
    pieces of one length comes first is not fixed. Other columns are not read.
    """
    found = cut(pieces(documents, vocabulary, end, capacity), "pieces")
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lengths = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(best_fit(lengths, capacity))
    shared = documents.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))  # by lengths, not by documents

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] * RANKS + table[:, 1]
        for some in batches:
            col = {name: some.column(name).to_numpy(zero_copy_only=False) for name in ("length", "nth", "before")}
            rank = col["before"] + col["nth"]
            run = table[np.searchsorted(keys, col["length"] * RANKS + rank, "right") - 1]
            step = rank - run[:, 1]
            sequence = run[:, 2] + step // run[:, 3]
            offset = run[:, 4] + step % run[:, 3] * col["length"]
            yield pa.record_batch(
                [*[some.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = found.join(counts.select("part", "length", "before"), ["part", "length"])
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
