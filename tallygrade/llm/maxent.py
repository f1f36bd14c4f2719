"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class, before). Both are log-linear in
hashed features: a bias, the word before, the word before that (a skip), and both
together. A feature is a row of a table with one weight for each outcome, so a batch
of tokens is scored by adding up four rows each. The most frequent words have classes of
equal size; all others share one class. Inside of it a word is found by decisions between
two halves of the words in the order of their counts, down to the word alone; the log odds of
a decision are those of the counted shares plus one hashed weight for each feature. Words
that were never learned from have one counted share together, so that every word has a probability.

The corpus is written as blocks of word numbers, each with its own vocabulary.
Word counts are summed by joins on the word, never held in one place; a word's number is its
rank by count, and how many words have each count is all a task needs besides. Gradient rounds
start from shared weights; every task takes steps over its blocks and reports how far
it moved, and the mean of those that moved a row moves it. Only tables of fixed size
reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrade.llm.language import fold
from tallygrade.llm.texts import filled, hashed, mixed, signed, slices, split_words
from tallygrade.session import cut

FOLDS, HELD_OUT = 5, 1
#: Classes of frequent words and words in each; rows of either table of weights.
CLASSES, WIDE = 32, 64
ROWS = 1 << 13
#: Gradient rounds; each takes another one of ROUNDS tokens as targets, so that all of them together take every token once.
ROUNDS = 3
BATCH = 1 << 14
#: Tokens whose outcomes are looked at together.
STRETCH = 1 << 11
RATE = 0.3
FAN = 64
#: Hashed weights of the decisions between the other words, the levels whose counted odds are listed, and their rate's first square.
DEEP, LISTED, CALM = 1 << 18, 18, 10.0
#: The number of the most frequent word; words that were not learned from have NEW set instead, 1 and 2 stand before a text.
FIRST, NEW = 3, np.uint64(1 << 63)
_END = xxhash.xxh3_64_intdigest(b"\n", 11)  # no word holds a line end
_KEYS = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in range(1, 6)]


def blocks(documents: DataFrame) -> DataFrame:
    """Rows of many documents each: ids, folds, lengths, word numbers, and the block's words with their counts to learn.

    The word numbers' lowest bytes come first, then the next ones and so on: mostly zeros, which take little room on disk.
    """

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, some in enumerate(slices(batches, "text")):
            words = split_words(filled(some.column("text")), lower=True)
            ends = words.starts[1:]
            tokens = np.insert(words.ids, ends, len(words.uniques)).astype(np.uint32)
            lengths = words.counts + 1
            vocabulary = np.concatenate([hashed(words.uniques, 11), np.array([_END], np.uint64)])
            held = some.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            learn = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(vocabulary))
            one = lambda values: pa.array([values])
            yield pa.record_batch(
                [
                    pa.array([(part << 32) + nth]), pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("doc_id").cast(pa.int64())),
                    one(held), one(lengths), pa.array([tokens.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()), one(signed(vocabulary)), one(learn.astype(np.int64)),
                ],
                ["block", "doc_ids", "held", "lengths", "tokens", "words", "learn"],
            )

    held = (F.coalesce(fold("doc_id", FOLDS), F.lit(0)) == HELD_OUT).alias("held_out")
    kinds = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words array<long>, learn array<long>"
    return documents.select("doc_id", held, "text").mapInArrow(made, kinds)


@dataclass
class Model:
    """heads: numbers of the frequent words, most frequent first; tables of weights; what the other words share, and weights of their decisions."""

    heads: np.ndarray
    first: np.ndarray
    second: np.ndarray
    rest: float
    rest_words: float
    deep: np.ndarray | None = None

    def place(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and place in it of each word; CLASSES for the class of all others."""
        order = np.argsort(self.heads)
        known = self.heads[order]
        at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        rank = np.where(known[at] == words, order[at], CLASSES * WIDE) if len(known) else np.full(len(words), CLASSES * WIDE)
        return rank // WIDE, rank % WIDE


class Order:
    """Words in the order of their counts: the counts that occur, falling, and how many words have each.

    The words after the heads are halved by rank: a decision at `level` is between two runs of 2^(levels - level - 1) ranks.
    """

    def __init__(self, counts: np.ndarray, often: np.ndarray) -> None:
        self.counts, self.often, ends = counts, often, np.cumsum(often)
        self.begins, self.size = ends - often, int(often.sum())
        self.tokens = int((counts * often).sum())
        self.mass = counts + 0.5
        self.before = np.cumsum(self.mass * often) - self.mass * often
        self.others = max(self.size - CLASSES * WIDE, 0)
        self.levels = max(self.others - 1, 0).bit_length()
        self.kind = np.uint32 if self.levels < 32 else np.uint64
        self.shifts = np.arange(self.levels, 0, -1, dtype=self.kind)[:, None]
        self.tops = (1 << np.arange(self.levels)).astype(self.kind)[:, None]
        self.halves = self.tops[::-1].copy()
        self.listed = min(self.levels, LISTED)
        below = self.below(np.arange((1 << self.listed) + 1) << (self.levels - self.listed)) if self.levels else None
        self.odds = np.zeros(1 << self.listed, np.float32)
        for level in range(self.listed):
            lo, mid, hi = (below[k * (1 << self.listed - level - 1) :: 1 << self.listed - level] for k in (0, 1, 2))
            self.odds[1 << level : 2 << level] = _log_odds(lo[: 1 << level], mid, hi)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """Which of the counts words of these ranks have."""
        return np.searchsorted(self.begins, ranks, "right") - 1

    def below(self, others: np.ndarray) -> np.ndarray:
        """What the words before the given ones have together; of words after the heads."""
        ranks = np.minimum(others, self.others) + CLASSES * WIDE
        k = self.at(ranks)
        return self.before[k] + (ranks - self.begins[k]) * self.mass[k]

    def steep(self, ranks: np.ndarray) -> np.ndarray:
        """Counted log odds of the second half, for the decisions beyond the listed levels that lead to words after the heads; a row a level."""
        t = ranks - CLASSES * WIDE
        high = np.arange(self.levels - self.listed, 0, -1)[:, None]
        lo = (t >> high) << high
        hi = lo + (1 << high)
        odds = np.zeros(lo.shape, np.float32)
        k = self.at(ranks)
        begins, ends = self.begins[k] - CLASSES * WIDE, np.append(self.begins[1:], self.size)[k] - CLASSES * WIDE
        uneven = (lo < begins) | (hi > ends)  # all others hold words of one count
        lo, hi = lo[uneven], hi[uneven]
        odds[uneven] = _log_odds(self.below(lo), self.below((lo + hi) >> 1), self.below(hi))
        return odds

    def decisions(self, ranks: np.ndarray, steep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, counted log odds of the second half, and outcomes of all decisions that lead to words after the heads; a row a level."""
        t = (ranks - CLASSES * WIDE).astype(self.kind)
        nodes = t >> self.shifts
        nodes |= self.tops
        odds = np.empty(nodes.shape, np.float32)
        odds[self.listed :] = steep
        odds[: self.listed] = self.odds.take(nodes[: self.listed], mode="clip")
        return nodes, odds, (t & self.halves) > 0


def _log_odds(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Log odds of what lies from mid to hi against what lies from lo to mid; -inf where there is nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(hi > mid, np.log((hi - mid) / (mid - lo)), -np.inf)


def deep_rows(one: np.ndarray, two: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Weights of the features of each decision: the word before, the one before that, both."""
    salt = nodes.astype(np.uint32) * np.uint32(0x9E3779B1)
    out = np.empty((3, *nodes.shape), np.int64)
    for x, code in zip(out, (one * _KEYS[0], two * _KEYS[1], one * _KEYS[2] + two * _KEYS[3]), strict=True):
        row = salt ^ (mixed(code) >> np.uint64(32)).astype(np.uint32)
        row *= np.uint32(0x85EBCA77)
        np.right_shift(row, np.uint32(33 - DEEP.bit_length()), out=x, casting="unsafe")
    return out


def _decided(deep: np.ndarray, order: Order, ranks: np.ndarray, steep: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a stretch that a core's cache holds: weights' rows, log odds, and outcomes of their decisions."""
    for a in range(0, len(ranks), STRETCH // 2):
        s = slice(a, min(a + STRETCH // 2, len(ranks)))
        nodes, z, second = order.decisions(ranks[s], steep[:, s])
        rows = deep_rows(one[s], two[s], nodes)
        for r in rows:
            z += deep.take(r, mode="clip")
        yield s, rows, z, second


def deep_step(deep: np.ndarray, squares: np.ndarray, order: Order, ranks: np.ndarray, steep: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """One gradient step on the decisions that lead to a batch of words."""
    sums = np.zeros(DEEP, np.float32)
    for _, rows, z, second in _decided(deep, order, ranks, steep, one, two):
        with np.errstate(over="ignore"):
            np.exp(np.negative(z, out=z), out=z)
        z += 1
        slopes = np.subtract(1 / z, second).ravel()
        for r in rows:
            np.add.at(sums, r.ravel(), slopes)
    squares += sums * sums
    deep -= RATE * sums / np.sqrt(squares + CALM)


def deep_logs(deep: np.ndarray, order: Order, ranks: np.ndarray, steep: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Log probability of each word among those after the heads that were learned from."""
    out = np.empty(len(ranks))
    for s, _, z, second in _decided(deep, order, ranks, steep, one, two):
        z *= 1 - 2 * second.astype(np.float32)
        far = np.abs(z)
        np.exp(np.negative(far, out=far), out=far)
        far += 1
        np.maximum(z, 0, out=z)
        z += np.log(far, out=far)
        out[s] = -z.sum(axis=0)
    return out


def contexts(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two places before each word; 1 and 2 before the begin of a text."""
    ends = np.cumsum(lengths)
    inside = np.arange(len(words)) - np.repeat(ends - lengths, lengths)
    one = np.where(inside >= 1, np.concatenate([[np.uint64(1)], words[:-1]]), np.uint64(1))
    two = np.where(inside >= 2, np.concatenate([np.full(min(2, len(words)), np.uint64(2)), words[:-2]]), np.uint64(2))
    return one, two


def rows_of(one: np.ndarray, two: np.ndarray, kind: np.ndarray | None) -> np.ndarray:
    """The four rows of each token's features; with kind, its class, those of the second table."""
    salt = np.zeros(1, np.uint64) if kind is None else (kind.astype(np.uint64) + np.uint64(1)) * _KEYS[4]
    keep = 1 if kind is None else CLASSES
    out = np.empty((4, len(one)), np.int64)
    out[0] = 0 if kind is None else kind
    for f, code in enumerate((one * _KEYS[0], two * _KEYS[1], one * _KEYS[2] + two * _KEYS[3]), 1):
        out[f] = keep + (mixed(code ^ salt) % np.uint64(ROWS - keep)).astype(np.int64)
    return out


def _centred(table: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Tokens of a stretch that a core's cache holds: sums of their rows less the largest, and the log of what their exponentials add up to."""
    n = rows.shape[1]
    space = np.empty((2, min(n, STRETCH), table.shape[1]), table.dtype)
    for a in range(0, n, STRETCH):
        t = slice(a, min(a + STRETCH, n))
        z, more = space[:, : t.stop - a]
        table.take(rows[0, t], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            table.take(r[t], axis=0, out=more, mode="clip")
            z += more
        z -= z.max(axis=1, keepdims=True)
        yield t, z, np.log(np.exp(z, out=more).sum(axis=1, keepdims=True))


def log_shares(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of all outcomes, one row for each token."""
    out = np.empty((rows.shape[1], table.shape[1]), table.dtype)
    for t, z, total in _centred(table, rows):
        np.subtract(z, total, out=out[t])
    return out


def log_share_of(table: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of one outcome of each token."""
    out = np.empty(len(target), table.dtype)
    for t, z, total in _centred(table, rows):
        out[t] = z[np.arange(len(z)), target[t]] - total[:, 0]
    return out


def step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One gradient step on a batch, with adaptive rates for each row."""
    g = log_shares(table, rows)
    np.exp(g, out=g)
    g[np.arange(len(target)), target] -= 1
    flat = rows.ravel().astype(np.uint16)  # short numbers are sorted by their digits
    order = np.argsort(flat, kind="stable")
    sorted_rows = flat[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    hit = sorted_rows[begins].astype(np.int64)
    ends = np.append(begins[1:], len(flat))
    order %= len(target)
    sums = np.empty((len(hit), table.shape[1]), table.dtype)
    at = 0
    while at < len(hit):  # whole rows of the table, as many as about a stretch of tokens moves
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + STRETCH, "right")))
        np.add.reduceat(g.take(order[begins[at] : ends[to - 1]], axis=0), begins[at:to] - begins[at], axis=0, out=sums[at:to])
        at = to
    sums /= np.maximum((ends - begins)[:, None] ** 0.5, 1)
    squares[hit] += (sums * sums).mean(axis=1)
    table[hit] -= RATE * sums / np.sqrt(squares[hit] + 1)[:, None]


def _moves(corpus: DataFrame, model: Model, order: Order, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean move of every weight over the tasks that moved its row: tables (2, ROWS, width), and over those that moved it: (DEEP,)."""
    shared = corpus.sparkSession.sparkContext.broadcast((model.heads, model.first, model.second, model.deep, order.counts, order.often))
    width = max(CLASSES + 1, WIDE)

    def learned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, first, second, deep, *runs = shared.value
        order = Order(*runs)
        mine = Model(heads, first.copy(), second.copy(), 0, 0, deep.copy())
        squares = [np.zeros(ROWS, np.float32), np.zeros(ROWS, np.float32), np.zeros(DEEP, np.float32)]
        seen = False
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, words, lengths, held = _read(batch, i)
                of = words[tokens]
                one, two = contexts(of, lengths)
                kind, at = mine.place(words)
                deeper, steep = _steep(order, words, kind)
                chosen = np.flatnonzero(np.repeat(~held, lengths))[turn::ROUNDS]
                seen = seen or len(chosen) > 0
                for a in range(0, len(chosen), BATCH):
                    t = chosen[a : a + BATCH]
                    k = kind[tokens[t]]
                    step(mine.first, squares[0], rows_of(one[t], two[t], None), k)
                    o = t[k == CLASSES]
                    if len(o) and order.levels:
                        deep_step(mine.deep, squares[2], order, _ranks(of[o]), steep[:, deeper[tokens[o]]], one[o], two[o])
                    t, k = t[k < CLASSES], k[k < CLASSES]
                    if len(t):
                        step(mine.second, squares[1], rows_of(one[t], two[t], k), at[tokens[t]])
        if seen:
            moved = np.zeros((2, ROWS, width + 1), np.float16)
            moved[0, :, : CLASSES + 1], moved[0, :, width] = mine.first - first, squares[0] > 0
            moved[1, :, :WIDE], moved[1, :, width] = mine.second - second, squares[1] > 0
            pieces = np.concatenate([moved.ravel(), mine.deep - deep, squares[2] > 0], dtype=np.float16).reshape(FAN, -1)
            part = TaskContext.get().partitionId()
            yield pa.record_batch(
                [pa.array(np.arange(FAN)), pa.array(np.full(FAN, part, np.int64)), pa.array([p.astype(np.float32).tobytes() for p in pieces], pa.binary())],
                ["piece", "part", "moved"],
            )

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32) for x in table.column("moved"))
        return pa.table({"piece": table.column("piece").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // FAN]), "moved": pa.array([total.tobytes()], pa.binary())})

    kinds = "piece long, part long, moved binary"
    corpus = corpus.select("held", "lengths", "tokens", "words")
    parts = corpus.mapInArrow(learned, kinds)
    level = max(1, corpus.rdd.getNumPartitions())
    while level > 1:  # at most FAN tables meet in a task
        parts = parts.groupBy("piece", F.floor(F.col("part") / FAN).alias("above")).applyInArrow(added, kinds)
        level = -(-level // FAN)
    got = {r["piece"]: np.frombuffer(r["moved"], np.float32) for r in parts.collect()}  # one table of fixed size
    if not got:
        return np.zeros((2, ROWS, width), np.float32), np.zeros(DEEP, np.float32)
    whole = np.concatenate([got[i] for i in range(FAN)])
    tables, (deep, tasks) = whole[: -2 * DEEP].reshape(2, ROWS, width + 1), whole[-2 * DEEP :].reshape(2, DEEP)
    return tables[:, :, :width] / np.maximum(tables[:, :, width:], 1), deep / np.maximum(tasks, 1)


def _ranks(words: np.ndarray) -> np.ndarray:
    return (words - np.uint64(FIRST)).astype(np.int64)


def _steep(order: Order, words: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a block the column that has its counted odds beyond the listed levels, and these columns."""
    others = (kind == CLASSES) & (words < NEW)
    return np.cumsum(others) - 1, order.steep(_ranks(words[others]))


def _read(batch: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    column = lambda name: np.asarray(batch.column(name)[i].values.to_numpy(zero_copy_only=False))
    tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
    return tokens, column("words").astype(np.int64).view(np.uint64), column("lengths").astype(np.int64), column("held").astype(bool)


def initial(heads: list[tuple[int, int]], tokens: int, words: int) -> Model:
    """Weights that give every word its share of all tokens, whatever stands before it."""
    counts = np.zeros(CLASSES * WIDE)
    counts[: len(heads)] = [n for _, n in heads]
    rest = tokens - counts.sum()
    groups = counts.reshape(CLASSES, WIDE)
    first, second = np.zeros((ROWS, CLASSES + 1), np.float32), np.zeros((ROWS, WIDE), np.float32)
    share = np.append(groups.sum(axis=1), rest) + 0.5
    first[0] = np.log(share / share.sum())
    first[0, :CLASSES][groups.sum(axis=1) == 0] = -60
    inner = np.where(groups > 0, np.log(np.maximum(groups, 1) / np.maximum(groups.sum(axis=1, keepdims=True), 1)), -60)
    second[:CLASSES] = inner
    return Model(np.array([w for w, _ in heads], np.int64).view(np.uint64), first, second, float(rest), float(words - len(heads)), np.zeros(DEEP, np.float32))


def _ranked(counts: DataFrame) -> tuple[DataFrame, Order]:
    """The rank of every word by count, and the order; words of one count go by their hash."""
    placed = counts.orderBy(F.desc("c"), "word").withColumn("id", F.monotonically_increasing_id())
    placed = cut(placed, "ranks", free_shuffles=True)
    part = F.shiftright("id", 33)
    sizes = dict(placed.groupBy(part).count().collect())  # one for each task that sorted
    before = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0)))]).tolist()
    rank = F.array(*map(F.lit, before))[part.cast("int")] + F.col("id") - F.shiftleft(part, 33)
    often = placed.groupBy("c").count().orderBy(F.desc("c")).collect()  # as many as counts occur: at most the root of twice the tokens
    order = Order(np.array([r["c"] for r in often], np.int64), np.array([r["count"] for r in often], np.int64))
    return placed.select("word", rank.alias("rank")), order


def _numbered(corpus: DataFrame, each: DataFrame, ranks: DataFrame) -> DataFrame:
    """corpus with numbers by rank instead of hashes for the words that were learned from."""

    def numbered(block: pa.Table, known: pa.Table) -> pa.Table:
        words = block.column("words")[0].values.to_numpy().view(np.uint64) | NEW
        words[known.column("at").to_numpy()] = known.column("rank").to_numpy() + FIRST
        return block.set_column(block.column_names.index("words"), "words", pa.array([words.view(np.int64)]))

    found = each.join(ranks, "word").select(F.col("block").alias("of"), "at", "rank")
    plain = corpus.drop("learn")
    return plain.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(numbered, plain.schema)


def lm_scores(documents: DataFrame) -> DataFrame:
    """Base and model scores of every row of documents (doc_id, text).

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: as log10
    probabilities of the whole text. Null and empty texts are the end token alone.
    Documents whose crc32 of doc_id has remainder 1 by 5 are not learned from; rows with
    a null id are. Every row gets its answer, repeated ones too. Without a text to learn
    from the model gives every text the same chance per token as the base. Other columns are not read.
    """
    corpus = cut(blocks(documents), "blocks")
    each = corpus.select("block", F.posexplode(F.arrays_zip("words", "learn")).alias("at", "w"))
    each = each.select("block", "at", F.col("w.words").alias("word"), F.col("w.learn").alias("learn"))
    ranks, order = _ranked(cut(each.where("learn > 0").groupBy("word").agg(F.sum("learn").alias("c")), "counts", free_shuffles=True))
    corpus = cut(_numbered(corpus, each, ranks), "numbered", free_shuffles=True)
    v, n = order.size, order.tokens
    tops = np.arange(min(v, CLASSES * WIDE))
    model = initial([*zip((tops + FIRST).tolist(), order.counts[order.at(tops)].tolist(), strict=True)], n, v)
    for turn in range(ROUNDS if n else 0):
        moved, deep = _moves(corpus, model, order, turn)
        model.first += moved[0, :, : CLASSES + 1]
        model.second += moved[1, :, :WIDE]
        model.deep += deep
    shared = documents.sparkSession.sparkContext.broadcast((astuple(model), order.counts, order.often))
    floor = n + 0.5 * (v + 1)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, *runs = shared.value
        model, order = Model(*weights), Order(*runs)
        new = 0.5 / (model.rest + 0.5 * (model.rest_words + 1))  # of the words not among the heads
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, words, lengths, held = _read(batch, i)
                known = words < NEW
                count = np.zeros(len(words))
                count[known] = order.counts[order.at(_ranks(words[known]))]
                begins = np.cumsum(lengths) - lengths
                base = np.log10((count + 0.5) / floor)
                kind, at = model.place(words)
                deeper, steep = _steep(order, words, kind)
                of = words[tokens]
                one, two = contexts(of, lengths)
                logs = np.empty(len(tokens))
                for a in range(0, len(tokens), BATCH):
                    t = np.arange(a, min(a + BATCH, len(tokens)))
                    mine, k = tokens[t], kind[tokens[t]]
                    got = log_share_of(model.first, rows_of(one[t], two[t], None), k).astype(float)
                    head = np.flatnonzero(k < CLASSES)
                    if len(head):
                        got[head] += log_share_of(model.second, rows_of(one[t][head], two[t][head], k[head]), at[mine[head]])
                    seen = known[mine]
                    other = np.flatnonzero(seen & (k == CLASSES))
                    if len(other):
                        o = t[other]
                        got[other] += math.log1p(-new) + deep_logs(model.deep, order, _ranks(of[o]), steep[:, deeper[mine[other]]], one[o], two[o])
                    got[~seen] += math.log(new)
                    logs[t] = got
                sums = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
                rows = len(lengths)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_ids")[i].values, "held_out": pa.array(held), "n_tokens": pa.array(lengths),
                        "n_known": pa.array(sums(known[tokens].astype(np.int64)).astype(np.int64)), "train_tokens": pa.array(np.full(rows, n, np.int64)),
                        "base_score": pa.array(sums(base[tokens])), "score": pa.array(sums(logs) / math.log(10)),
                    }
                )

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return corpus.select("doc_ids", "held", "lengths", "tokens", "words").mapInArrow(scored, kinds)
