"""Token-ID output: texts as coded frames of ids in order of doc_id, and back.

A file is a table of frames (shard, nth, n_ids, documents, frame): Spark writes and commits it,
so that a lost executor leaves no half file, on any store. Shards are ranges of doc_id,
their frames follow each other; a frame holds whole documents and is decoded alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrade.llm.coder import decode, encode
from tallygrade.llm.texts import slices
from tallygrade.llm.tokens import SLICE_BYTES, encoded, load, with_end

#: Ids after which a frame is closed; a longer document has a frame of its own.
FRAME = 1 << 22


def frames(documents: DataFrame, vocabulary: str, end: int, most: int = FRAME) -> DataFrame:
    """The frames of all documents (doc_id, text), in ascending doc_id order, nulls first.

    Each document is the ids of its whole text and the end id; null texts are empty.
    Rows with equal doc_id stand next to each other.
    """

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        shard, nth = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        counts: list[np.ndarray] = []

        def frame() -> pa.RecordBatch:
            flat, lengths, of = np.concatenate(ids), np.concatenate(counts), pa.concat_arrays(names)
            for held in (ids, counts, names):
                held.clear()
            ends = pa.array([0, len(of)], pa.int32())
            columns = [
                pa.array([shard], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(flat)], pa.int64()), pa.ListArray.from_arrays(ends, of),
                pa.ListArray.from_arrays(ends, pa.array(lengths)), pa.array([encode(flat)], pa.binary()),
            ]
            return pa.record_batch(columns, ["shard", "nth", "n_ids", "doc_ids", "lengths", "frame"])

        for some in slices(batches, "text", SLICE_BYTES):
            flat, lengths = with_end(*encoded(tokenizer, some.column("text"), spaces=True), end)
            ends = np.cumsum(lengths)
            name = some.column("doc_id").cast(pa.int64())
            at = 0
            while at < len(lengths):
                before = int(ends[at - 1]) if at else 0
                room = most - sum(map(len, ids))
                to = max(at + (not ids), int(np.searchsorted(ends, before + room, "right")))
                if to > at:
                    ids.append(flat[before : ends[to - 1]])
                    counts.append(lengths[at:to])
                    names.append(name.slice(at, to - at))
                if to < len(lengths):
                    yield frame()
                    nth += 1
                at = to
        if ids:
            yield frame()

    kinds = "shard int, nth int, n_ids long, doc_ids array<long>, lengths array<long>, frame binary"
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(made, kinds)


def write_ids(documents: DataFrame, path: str, vocabulary: str, end: int, most: int = FRAME) -> None:
    """Write the documents' ids to path."""
    frames(documents, vocabulary, end, most).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the file, from its decoded ids.

    start: how many ids stand before it in the file. ids are checked block by block; a
    damaged file is an error. An empty file gives no rows.
    """
    file = spark.read.parquet(path)
    sizes = file.select("shard", "nth", "n_ids")  # a row for every few million ids
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    above = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("shard", "nth", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("more")).join(shards, "shard")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch.column("frame")[i].as_py())
                names, lengths = batch.column("doc_ids")[i].values, batch.column("lengths")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) != lengths.sum():
                    raise ValueError("a frame of token ids has another length than its documents")
                start = np.cumsum(lengths) - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), lengths.tolist())]
                where = [pa.array(np.full(len(names), batch.column(c)[i].as_py(), np.int32)) for c in ("shard", "nth")]
                yield pa.record_batch([*where, names, pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())], ["shard", "nth", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = file.select("shard", "nth", "doc_ids", "lengths", "frame").mapInArrow(read, "shard int, nth int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(begins, ["shard", "nth"]).select("doc_id", (F.col("first") + F.col("more") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
