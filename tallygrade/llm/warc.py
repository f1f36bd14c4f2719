"""WARC archives: pages written as records, and records read from byte ranges of large files.

A reader that starts inside a file cannot tell a record from text that looks like one. So every task
emits what may be a record, with the offset where its header says that the next one begins;
pointer jumping from the file's start keeps those that are on the chain, and the rest is payload.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrade.llm.texts import slices
from tallygrade.session import cut

# Fixed values of the format.
LINE = "\r\n"
BLANK = "\r\n\r\n"
MAGIC = "WARC/1."
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are always written whole.
LEAST_PAYLOAD = 100
#: Blocks of files whose chain offsets one broadcast holds (about 100 bytes each).
BLOCKS = 1 << 18


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html), F.lit(""))


def _safe(value: Column) -> Column:
    """A header's value without line ends, which would begin another header."""
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def record_texts(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least: int = LEAST_PAYLOAD) -> DataFrame:
    """(value): one WARC record per row of pages (page_id, url, html), without the blank lines that end it.

    Of rows with equal payloads of at least `least` bytes those with the smallest page_id are
    responses, the others revisits of it without a payload. Null html is an empty payload, a null url
    leaves the target out. Repeated rows with the smallest page_id are all responses; a payload whose
    page_ids are all null has responses only, and a null page_id beside others is a revisit. Other columns are ignored.
    """
    facts = pages.select("page_id", "url", _payload("html").alias("body")).withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    large = F.octet_length("body") >= least
    # Partial aggregates: a payload in a third of all rows is one row per task before the shuffle.
    same = facts.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = cut(same.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("same"), "first"), "warc-same")
    # A small table is broadcast by its size; a large one is a sort-merge join, whose hot payloads AQE splits.
    joined = facts.join(same, F.when(large, F.col("digest")) == F.col("same"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{BLANK}")
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    head = F.concat_ws(
        LINE,
        F.lit(MAGIC + "1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(head, F.lit(BLANK), block).alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write pages as WARC files, one per task; Spark commits them, so that a lost executor leaves no half file."""
    record_texts(pages, **options).write.option("lineSep", BLANK).text(path)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of all files in the byte ranges that tasks read, in order.

    Lines end with one line feed: of longer marks the range reader loses some that lie across two ranges.
    """
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What may be a record in each block, with the place where its header ends and the length that it gives.

    Offsets count from the block's first line. A block's own row has its bytes and, of a header that
    began in an earlier block, the length and the end.
    """
    kinds = {"file": pa.string(), "block": pa.int64(), "at": pa.int64(), "declared": pa.int64(), "ends": pa.int64(), "bytes": pa.int64()}
    where, place, done = None, 0, []
    start = declared = ends = None
    head = True  # no record has begun and no header has ended in this block

    def close() -> None:
        if where:
            if start is not None:
                done.append((*where, start, declared, None, None))
            done.append((*where, None, inherited[0], inherited[1], place))

    def batch_of() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds.values())], list(kinds))
        done.clear()
        return out

    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        sizes, marks, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bytes", "mark", "number"))
        for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
            if hi == lo:
                continue
            here = (files[lo].as_py(), int(blocks[lo]))
            if here != where:
                close()
                where, place, start, declared, head, inherited = here, 0, None, None, True, [None, None]
            after = place + np.cumsum(sizes[lo:hi])
            for i in np.flatnonzero(marks[lo:hi]).tolist():
                kind = marks[lo + i]
                if kind == 1:
                    start, declared, head = int(after[i] - sizes[lo + i]), None, False
                elif kind == 2 and head and inherited[0] is None:
                    inherited[0] = int(numbers[lo + i])
                elif kind == 2 and start is not None and declared is None:
                    declared = int(numbers[lo + i])
                elif kind == 3 and head:
                    inherited[1], head = int(after[i]), False
                elif kind == 3 and start is not None:
                    if declared is not None:
                        done.append((*where, start, declared, int(after[i]), None))
                    start = None
            place = int(after[-1])
        if done:
            yield batch_of()
    close()
    if done:
        yield batch_of()


def candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, block, at, next) of all that may be a record, and (file, block, base, size) of all blocks.

    at: the record's offset in its file; next: where it says that its successor begins. base: the offset of
    the block's first line, size: of the file. Only places and lengths leave the tasks.
    """
    length = F.regexp_extract("value", r"(?i)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$", 1)
    mark = F.when(F.col("value").startswith(MAGIC), 1).when(length != "", 2).when(F.col("value") == "\r", 3).otherwise(0)
    slim = lines.select("file", "block", (F.octet_length("value") + 1).cast("long").alias("bytes"), mark.alias("mark"), F.when(length != "", length.cast("long")).otherwise(0).alias("number"))
    marks = cut(slim.mapInArrow(_marks, "file string, block long, at long, declared long, ends long, bytes long"), "warc-marks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = marks.where("bytes IS NOT NULL").withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))  # a row for each range of a file
    blocks = blocks.select(
        "file", "block", "base", F.sum("bytes").over(Window.partitionBy("file")).alias("size"),
        F.first("declared", True).over(behind).alias("later"), F.first(F.col("base") + F.col("ends"), True).over(behind).alias("later_ends"),
    )
    blocks = cut(blocks, "warc-blocks")
    ends = F.coalesce(F.col("base") + F.col("ends"), F.col("later_ends"))
    follows = ends + F.coalesce("declared", "later") + len(BLANK)
    found = marks.where("at IS NOT NULL").join(blocks, ["file", "block"]).select("file", "block", (F.col("base") + F.col("at")).alias("at"), follows.alias("next"))
    return cut(found.where("next IS NOT NULL"), "warc-candidates"), blocks


def reachable(found: DataFrame) -> DataFrame:
    """(file, at) of the records on the chain that begins at offset 0 of each file.

    Pointer jumping: a round doubles the pointers' reach and adds as many records to the chain as it
    has, so that a file of n records takes log2(n) rounds. Keys are (file, offset), none is hot.
    """
    jump = found.select("file", "at", F.col("next").alias("to"))
    front = found.where("at = 0").select("file", "at")
    parts = [front]
    while True:
        chain = parts[0]
        for part in parts[1:]:
            chain = chain.unionByName(part)
        step = cut(chain.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(found.select("file", "at"), ["file", "at"]), "warc-chain")
        if step.isEmpty():
            return chain
        parts.append(step)
        further = jump.select("file", F.col("at").alias("from"), F.col("to").alias("at")).join(jump, ["file", "at"])
        jump = cut(further.select("file", F.col("from").alias("at"), "to"), "warc-jumps")


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task put together to records, or to the parts of one that goes on in the next block."""
    kinds = {"file": pa.string(), "at": pa.int64(), "part": pa.int64(), "whole": pa.bool_(), "data": pa.binary()}
    wanted = re.compile(rb"(?i)Content-Length:[ \t]*([0-9]+)")
    where, place, at, follows, held = None, 0, None, None, []
    begun = scanning = False
    declared = None
    done: list[tuple] = []

    def close() -> None:
        """What is held belongs to the record at `at`; it is all of it if it began here and its last byte is there."""
        if at is not None and held:
            data = b"".join(held)
            done.append((where[0], at, where[1], begun and not scanning and at + len(data) == follows, data))

    for batch in slices(batches, "value"):
        files, blocks = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        value = batch.column("value")
        for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
            here = (files[lo].as_py(), int(blocks[lo]))
            if here != where:
                close()
                base, entry, owner = (batch.column(c)[lo].as_py() for c in ("base", "entry", "owner"))
                where, place, at, follows, held, begun, scanning = here, base, owner, entry, [], False, False
            lines = value.slice(lo, hi - lo).to_pylist()
            ends = place + np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
            starts = np.concatenate([[place], ends[:-1]])
            place, i = int(ends[-1]), 0
            while i < len(lines):
                if scanning:  # the header of the record that begins at `at`
                    to = i
                    while to < len(lines) and lines[to] != b"\r":
                        length = wanted.match(lines[to]) if declared is None else None
                        declared = int(length[1]) if length else declared
                        to += 1
                    if to < len(lines):
                        follows, scanning = int(ends[to]) + declared + len(BLANK), False
                        to += 1
                else:
                    to = len(lines) if follows is None else int(np.searchsorted(starts, follows))
                if to > i:
                    held.append(b"\n".join(lines[i:to]) + b"\n")
                i = to
                if i < len(lines) and not scanning and starts[i] == follows:
                    close()
                    at, held, begun, scanning, declared = follows, [], True, True, None
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds.values())], list(kinds))
            done.clear()
    close()
    if done:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds.values())], list(kinds))


def header(name: str) -> Column:
    """The value of a header field of the column `header`; null where the record has none."""
    value = F.regexp_extract("header", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record_type, record_id, uri, refers_to, digest, payload) of every record of uncompressed WARC files.

    payload is binary, without the HTTP head that it came with. A file whose chain does not
    lead to its very end (damaged, cut off, not WARC) is an error that names it. Empty files have no records.
    Files may be cut into any byte ranges; a task holds one record at a time, and parts of a record that lie
    in several ranges meet by the record's offset.
    """
    lines = lines_of(spark, path)
    found, blocks = candidates(lines)
    chain = cut(reachable(found).join(found, ["file", "at"]), "warc-reached")
    ends = chain.groupBy("file").agg(F.max("next").alias("end"))
    broken = blocks.select("file", "size").distinct().join(ends, "file", "left").where("end IS NULL OR end <> size")
    names = [r.file for r in broken.select("file").limit(5).collect()]
    if names:
        raise ValueError(f"the records of these files do not lead to their end: {', '.join(names)}")
    entries = chain.groupBy("file", "block").agg(F.min("at").alias("entry"), F.max("at").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    side = blocks.join(entries, ["file", "block"], "left").withColumn("owner", F.max("last").over(before)).select("file", "block", "base", "entry", "owner")
    side = cut(side, "warc-entries")
    groups = -(-side.count() // BLOCKS)  # one row a block of the file system; more than a broadcast may hold are read group by group
    parts = None
    for g in range(max(1, groups)):
        mine = F.pmod(F.xxhash64("file"), F.lit(max(1, groups))) == g
        some = lines.where(mine).join(F.broadcast(side.where(mine)), ["file", "block"])
        some = some.select("file", "block", "base", "entry", "owner", F.col("value").cast("binary").alias("value")).mapInArrow(
            _joined, "file string, at long, part long, whole boolean, data binary"
        )
        parts = some if parts is None else parts.unionByName(some)
    split = parts.where("NOT whole").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("p"))  # one record in each
    split = split.select("file", "at", F.expr("aggregate(p, cast('' AS binary), (a, x) -> concat(a, x.data))").alias("data"))
    records = parts.where("whole").select("file", "at", "data").unionByName(split)
    records = records.withColumn("header", F.substring_index(F.col("data").cast("string"), BLANK, 1))
    size = header("Content-Length").cast("int")
    block = F.substring(F.col("data"), F.octet_length("header") + len(BLANK) + 1, size)
    records = records.select("file", "at", "header", block.alias("block"))
    http = F.coalesce(header("Content-Type").startswith("application/http"), F.lit(False))
    head = F.octet_length(F.substring_index(F.col("block").cast("string"), BLANK, 1)) + len(BLANK)
    payload = F.when(http, F.substring(F.col("block"), head + 1, F.octet_length("block"))).otherwise(F.col("block"))
    return records.select(
        "file", "at", header("WARC-Type").alias("record_type"), header("WARC-Record-ID").alias("record_id"), header("WARC-Target-URI").alias("uri"),
        header("WARC-Refers-To").alias("refers_to"), F.regexp_replace(header("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), payload.alias("payload"),
    )


def page_facts(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that `write_archives` wrote.

    A revisit has the size and digest of the response that it names, found by page_id and digest.
    """
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    facts = cut(
        records.select(
            number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
            "record_type", number("refers_to").alias("refers_to"), "digest",
        ),
        "warc-facts",
    )
    responses = facts.where("record_type = 'response'")
    revisits = facts.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest")
    known = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = revisits.join(known, ["refers_to", "digest"], "left").withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("digest")))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*names).unionByName(again.select(*names))
