"""Quality classifier by co-training: a view of the text and a view of the page's metadata.

Both views start from the labelled sample. In each round either classifier scores a pool
of unlabelled documents, and what it is sure of becomes training data of the other one.
At last both are calibrated on labelled rows that neither has seen, and combined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrade.llm import linear
from tallygrade.llm.linear import Sparse
from tallygrade.llm.rules import FAMILIES, SIZE, SLICE, SYMBOLS, labelled_sample, logits, repeated_lines, vectors
from tallygrade.llm.texts import Words, bytes_of, filled, hashed, slices, split_words

#: Labelled and unlabelled documents that the classifiers are fitted on at most, chosen by a hash of doc_id.
LABELLED, POOL = 1200, 1200
ROUNDS = 3
#: How sure a view must be, and how many documents of a class it may hand over in a round.
SURE, GIVEN = 0.95, 100
KEEP = 0.5
SLOTS = 1 << 14
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def metadata(part: pa.RecordBatch, texts: pa.Array, words: Words) -> Sparse:
    """The metadata view: language, source, stated length, and the page's form in steps; one slot each."""
    raw, at = bytes_of(texts)
    size = np.maximum(np.diff(at), 1)

    def share(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        sums = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return (sums[at[1:]] - sums[at[:-1]]) / size

    owner = words.text_of()
    distinct = np.bincount(np.unique(owner * (len(words.uniques) + 1) + words.ids) // (len(words.uniques) + 1), minlength=len(texts)) if len(owner) else np.zeros(len(texts))
    lines = share(b"\n") * size + 1
    chars = pc.fill_null(part.column("n_chars").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    steps = [
        np.where(chars < 0, -1, np.log2(np.maximum(chars, 1)) // 1), np.log2(words.counts + 1) // 1, 10 * distinct // np.maximum(words.counts, 1),
        np.log2(1 + 1000 * share(SYMBOLS)) // 1, np.log2(1 + 1000 * share(bytes(range(65, 91)))) // 1, np.log2(1 + 1000 * share(b"0123456789")) // 1,
        np.log2(1 + 1000 * share(b"!?.,;:")) // 1, np.log2(1 + words.counts / lines) // 1, 10 * repeated_lines(texts) // lines, size / np.maximum(words.counts, 1) // 1,
    ]
    slots = [hashed(pc.binary_join_element_wise(name, pc.fill_null(part.column(name).cast(pa.string()), ""), "=")) % np.uint64(SLOTS) for name in ("lang", "source")]
    slots += [((s.astype(np.int64) + 64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64)) >> np.uint64(50) for k, s in enumerate(steps)]
    index = np.stack(slots, axis=1).astype(np.int64)
    return Sparse(np.arange(len(texts) + 1) * len(slots), index.ravel(), np.ones(index.size))


def _views(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, Sparse, Sparse]:
    """doc_id, y and both views of bounded rows (doc_id, y, text, lang, source, n_chars), in order of doc_id."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            texts = filled(part.column("text"))
            one, two = vectors(texts), metadata(part, texts, split_words(texts))
            lists = [
                pa.ListArray.from_arrays(pa.array(x.starts.astype(np.int32)), pa.array(v))
                for x, v in ((one, one.index.astype(np.int32)), (one, one.value.astype(np.float32)), (two, two.index.astype(np.int32)))
            ]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("y"), *lists], ["doc_id", "y", "index", "value", "slots"])

    got = rows.select("y", *COLUMNS).mapInArrow(made, "doc_id long, y int, index array<int>, value array<float>, slots array<int>").toArrow()
    ids = got.column("doc_id").to_numpy()
    y = got.column("y").to_numpy().astype(float)
    index, value, slots = (got.column(c).combine_chunks() for c in ("index", "value", "slots"))
    starts = lambda lists: np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    text = Sparse(starts(index), index.flatten().to_numpy(), value.flatten().to_numpy()).rows(order)
    meta = Sparse(starts(slots), slots.flatten().to_numpy(), np.ones(len(slots.flatten()), np.float32)).rows(order)
    return ids[order], y[order], text, meta


def _joined(a: Sparse, b: Sparse) -> Sparse:
    return Sparse(np.concatenate([a.starts, b.starts[1:] + a.starts[-1]]), np.concatenate([a.index, b.index]), np.concatenate([a.value, b.value]))


def train(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> tuple:
    """Weights and biases of both views, and the combination (weight of each, shift), from bounded samples."""
    sample = labelled_sample(documents, labels, "quality", LABELLED).select("doc_id", "y")
    whole = documents.select(*COLUMNS)
    _, y, text, meta = _views(whole.join(sample, "doc_id"))
    place = F.pmod(F.xxhash64(F.lit("pool"), F.col("doc_id").cast("string")), F.lit(1 << 24))
    free = documents.select("doc_id").where("doc_id is not null and text is not null").join(labels.select("doc_id"), "doc_id", "left_anti")
    total = free.count()
    near = free.where(place < max(1, int(2.0 * POOL / max(total, 1) * (1 << 24)))).orderBy(place, "doc_id").limit(POOL)
    _, _, pool_text, pool_meta = _views(whole.join(near.distinct(), "doc_id").withColumn("y", F.lit(0)))
    late = np.arange(len(y)) % 4 == 3
    views = [(text, pool_text, FAMILIES * SIZE), (meta, pool_meta, SLOTS)]
    given: list[dict[int, float]] = [{}, {}]
    fits: list[tuple[np.ndarray, float]] = []
    for turn in range(rounds + 1):
        fits = []
        for v, (own, pool, size) in enumerate(views):
            taken = np.array(sorted(given[v]), np.int64)
            x = _joined(own.rows(np.flatnonzero(~late)), pool.rows(taken))
            target = np.concatenate([y[~late], [given[v][i] for i in taken.tolist()]])
            fits.append(linear.fit(x, target, size))
        if turn == rounds:
            break
        for v, (own, pool, _) in enumerate(views):
            w, b = fits[v]
            slope, shift = linear.calibrate(own.rows(np.flatnonzero(late)).times(w) + b, y[late])
            p = linear.sigmoid(slope * (pool.times(w) + b) + shift)
            for goal, order in ((1.0, np.argsort(-p, kind="stable")), (0.0, np.argsort(p, kind="stable"))):
                sure = [i for i in order.tolist() if abs(p[i] - goal) <= 1 - SURE and i not in given[1 - v]]
                given[1 - v].update(dict.fromkeys(sure[:GIVEN], goal))
    scores = np.stack([own.rows(np.flatnonzero(late)).times(w) + b for (own, _, _), (w, b) in zip(views, fits)], axis=1)
    tuned = [linear.calibrate(scores[:, v], y[late]) for v in (0, 1)]
    both = np.stack([a * scores[:, v] + c for v, (a, c) in enumerate(tuned)], axis=1)
    pairs = Sparse(np.arange(len(both) + 1) * 2, np.tile([0, 1], len(both)), both.ravel())
    last = linear.fit(pairs, y[late], 2, rounds=300)
    if not last[0].any():  # one class only
        last = np.full(2, 0.5), 0.0
    return [(w.astype(np.float32), b, *t) for (w, b), t in zip(fits, tuned)], last


def cotrained(documents: DataFrame, labels: DataFrame, threshold: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """Both views' and the combined probability of good quality for every row of documents.

    doc_id, text_score, meta_score, score, kept (score reaches `threshold`). Reads doc_id,
    text, lang, source, n_chars; nulls in them count as values of their own, null and empty
    texts have no text features. Repeated rows each get their answer. Without labels, or
    with those of one class, the views say the share of good rows (one half without any).
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, rounds))  # weights of fixed size

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, last = shared.value
        (w1, b1, a1, c1), (w2, b2, a2, c2) = views
        for part in slices(batches, "text", SLICE):
            texts = filled(part.column("text"))
            words = split_words(texts)
            of = hashed(words.uniques)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
            one = a1 * (logits(texts, words, of, w1) + b1) + c1
            two = a2 * (metadata(part, texts, words).times(w2) + b2) + c2
            score = linear.sigmoid(last[0][0] * one + last[0][1] * two + last[1])
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(linear.sigmoid(one)), pa.array(linear.sigmoid(two)), pa.array(score), pa.array(score >= threshold)]
            yield pa.record_batch(columns, ["doc_id", "text_score", "meta_score", "score", "kept"])

    return documents.select(*COLUMNS).mapInArrow(scored, "doc_id long, text_score double, meta_score double, score double, kept boolean")
