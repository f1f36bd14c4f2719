"""Quality rules: base counts, and a hashed n-gram logistic regression on labelled quality rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrade.llm import linear
from tallygrade.llm.linear import Sparse
from tallygrade.llm.texts import Words, bytes_of, filled, give_back, hashed, mixed, slices, split_words, windows

#: Rows of labels that the model is fitted on at most, chosen by a hash of doc_id; every fifth only calibrates.
SAMPLE = 2000
SIZE = 1 << 18
#: Fixed threshold of the calibrated probability of good quality.
KEEP = 0.5
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
BYTES = (3, 4)
FAMILIES = 2 + len(BYTES)
#: Bytes of text in a slice, and those whose runs are weighed at a time.
SLICE, STRETCH = 8 << 20, 1 << 20
#: The same where whole rows go through a task.
ROWS_SLICE = 2 << 20
SYMBOLS = b"#*$%&|<>"


def repeated_words(of: np.ndarray, words: Words) -> np.ndarray:
    """How many words of each text lie in a window found twice or more in it."""
    found, first = windows(of, words.starts, WINDOW)
    owner = words.text_of()[first]
    keys = mixed(found + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(of) + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[words.starts[1:]] - covered[words.starts[:-1]]


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """How many \\n-split lines with a word equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = worded[line] if len(line) else np.zeros(0, bool)
    owner, line = owner[keep], line[keep]
    distinct = np.unique(owner * (len(worded) + 1) + line) // (len(worded) + 1)
    return np.bincount(owner, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def base_counts(texts: pa.Array, words: Words, of: np.ndarray) -> dict[str, np.ndarray]:
    sizes = pc.utf8_length(words.uniques).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.concatenate([[0], np.cumsum(sizes[words.ids] if len(words.ids) else np.zeros(0, np.int64))])
    raw, at = bytes_of(texts)
    marked = np.zeros(256, bool)
    marked[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(marked[raw], dtype=np.int64)])
    return {
        "n_words": words.counts,
        "word_chars": letters[words.starts[1:]] - letters[words.starts[:-1]],
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeated_words(of, words),
    }


def word_grams(words: Words, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed single words and word pairs in a row, and where each text begins among them."""
    pairs, first = windows(of, words.starts, 2)
    return [((of >> np.uint64(46)).astype(np.int32), words.starts), ((pairs >> np.uint64(46)).astype(np.int32), np.searchsorted(first, words.starts))]


def byte_grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Hashed runs of n bytes, one beginning at each byte but the last n - 1."""
    count = len(raw) - n + 1
    if count <= 0:
        return np.zeros(0, np.int32)
    code = raw[:count].astype(np.uint32)
    for j in range(1, n):
        code |= raw[j : count + j].astype(np.uint32) << np.uint32(8 * j)
    code = ((code * np.uint32(0x9E3779B1 + 2 * n)) ^ (code >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return (code >> np.uint32(14)).astype(np.int32)


def vectors(texts: pa.Array) -> Sparse:
    """Features of each text: shares of its n-grams in each family (words, word pairs, 3 and 4 bytes)."""
    words = split_words(texts)
    of = hashed(words.uniques)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    raw, at = bytes_of(texts)
    families = word_grams(words, of)
    starts, index, value, total = [0], [], [], 0
    for i in range(len(texts)):
        own = raw[at[i] : at[i + 1]]
        grams = [features[begin[i] : begin[i + 1]] for features, begin in families] + [byte_grams(own, n) for n in BYTES]
        for f, mine in enumerate(grams):
            if len(mine):
                slots, counts = np.unique(mine, return_counts=True)
                index.append(slots + np.int32(f * SIZE))
                value.append((counts / len(mine)).astype(np.float32))
                total += len(slots)
        starts.append(total)
    return Sparse(np.array(starts), np.concatenate([*index, np.zeros(0, np.int32)]), np.concatenate([*value, np.zeros(0, np.float32)]))


def logits(texts: pa.Array, words: Words, of: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The model's score of each text, without its bias: mean weights of all n-grams in each family."""
    total = np.zeros(len(texts))
    for f, (features, at) in enumerate(word_grams(words, of)):
        sums = np.concatenate([[0.0], np.cumsum(weights[f * SIZE : (f + 1) * SIZE][features], dtype=np.float64)])
        total += (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
    raw, at = bytes_of(texts)
    for f, n in enumerate(BYTES, 2):
        mine = weights[f * SIZE : (f + 1) * SIZE]
        # a run of bytes belongs to the text it lies in; the last n - 1 bytes of a text begin none
        ends = np.maximum(at[1:] - (n - 1), at[:-1])
        sums = np.zeros(len(texts))
        for c in range(0, len(raw), STRETCH):
            part = np.concatenate([[0.0], np.cumsum(mine[byte_grams(raw[c : c + STRETCH + n - 1], n)], dtype=np.float64)])
            a, z = int(np.searchsorted(at, c, "right")) - 1, int(np.searchsorted(at, c + STRETCH, "left"))
            begin, end = (np.clip(x[a:z] - c, 0, len(part) - 1) for x in (at[:-1], ends))
            sums[a:z] += part[end] - part[begin]
        total += sums / np.maximum(ends - at[:-1], 1)
    return total


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, texts: pa.Array, words: Words, of: np.ndarray) -> np.ndarray:
        return linear.sigmoid(self.slope * (logits(texts, words, of, self.weights) + self.bias) + self.shift)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text) of about `most` labelled documents, at most that many, chosen by a hash of doc_id.

    Labels of one document are averaged and rounded; rows without doc_id or label are left out.
    """
    rows = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    total = rows.count()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    rows = rows.where(place < max(1, int(1.0 * most / max(total, 1) * (1 << 20)))).orderBy(place, "doc_id").limit(most)
    texts = documents.select("doc_id", "text").where("text is not null")
    return texts.join(rows, "doc_id")


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QualityModel:
    """Fit on the labelled sample; every fifth of its rows calibrates instead."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            x = vectors(filled(part.column("text")))
            ends = pa.array(x.starts.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.index.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x.value.astype(np.float32)))]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("y"), *lists], ["doc_id", "y", "index", "value"])

    kinds = "doc_id long, y int, index array<int>, value array<float>"
    got = labelled_sample(documents, labels, "quality", most).mapInArrow(made, kinds).toArrow()  # bounded by `most` rows
    y = got.column("y").to_numpy().astype(float)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    index, value = got.column("index").combine_chunks(), got.column("value").combine_chunks()
    del got
    lengths = pc.list_value_length(index).to_numpy(zero_copy_only=False)
    x = Sparse(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), index.flatten().to_numpy(), value.flatten().to_numpy())
    late = np.arange(len(y)) % 5 == 4
    held, fitted = x.rows(order[late]), x.rows(order[~late])
    del x, index, value
    w, b = linear.fit(fitted, y[order[~late]], FAMILIES * SIZE)
    slope, shift = linear.calibrate(held.times(w) + b, y[order[late]])
    del held, fitted
    give_back()
    return QualityModel(w.astype(np.float32), b, slope, shift)


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = KEEP, most: int = SAMPLE) -> DataFrame:
    """Base counts, the base verdict and the model's verdict for every row of documents (doc_id, text).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, quality (calibrated probability). kept: not base_failed, and quality reaches
    `threshold`. Null and empty texts have no words and fail. Null ids and repeated rows
    each get their answer. Without labels the model says the same of all texts and, its
    probability being one half, keeps what passes the base. Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(astuple(train(documents, labels, most)))  # FAMILIES * SIZE weights

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = QualityModel(*shared.value)
        for part in slices(batches, "text", SLICE):
            texts = filled(part.column("text"))
            words = split_words(texts)
            of = hashed(words.uniques)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
            counts = base_counts(texts, words, of)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
            quality = model.probability(texts, words, of)
            kept = ~failed & (quality >= threshold)
            yield pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), *[pa.array(c.astype(np.int64)) for c in counts.values()], pa.array(failed), pa.array(kept), pa.array(quality)],
                ["doc_id", *counts, "base_failed", "kept", "quality"],
            )

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"
    return documents.select("doc_id", "text").mapInArrow(scored, kinds)


def passing(documents: DataFrame, labels: DataFrame, threshold: float = KEEP, most: int = SAMPLE) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns, judged in the same scan.

    Null and empty texts fail; repeated rows and null ids are each judged by their text. An empty table gives an empty table.
    """
    shared = documents.sparkSession.sparkContext.broadcast(astuple(train(documents, labels, most)))

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = QualityModel(*shared.value)
        for part in slices(batches, "text", ROWS_SLICE):
            texts = filled(part.column("text"))
            words = split_words(texts)
            of = hashed(words.uniques)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
            failed = (words.counts < MIN_WORDS) | (100 * repeated_words(of, words) > REPEAT_PERCENT * words.counts)
            yield part.filter(pa.array(~failed & (model.probability(texts, words, of) >= threshold)))

    return documents.mapInArrow(chosen, documents.schema)
