"""Adaptive context-mixing range coder for token ids, many blocks in step.

Ids are cut into blocks; each starts from a fresh model, so blocks are coded side by
side, one id of each at a time, as arrays. An id is predicted from the two ids before it
(order 2), from the one before it (order 1) and by size alone (order 0):

1. Is it the id that last followed the same two ids (or, where these are new, the same
   one id)? The hit rates of both orders at their present confidence and the block's own
   hit rate are mixed in the logistic domain, with weights that learn.
2. If not, is it what followed the one id before?
3. If not, its number of bits by adaptive counts, then the bits.

Only integers are used, so that every machine decodes what another has coded. Bytes of a
frame: magic, number of ids, ids of a block, then for each block its count of 16-bit words
and the CRC-32 of its words and ids, then all words. A block that doesn't decode to its checksum is
an error.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"TCM1"
BLOCK = 4096
MOST = 1 << 16
SLOTS = 1 << 11
LEVELS = 16
KINDS = MOST.bit_length()
_BOT = np.uint64(1 << 32)
_STRETCH = np.array([max(-2047, min(2047, round(math.log(max(p, 0.5) / (4096 - max(p, 0.5))) * 256))) for p in range(4096)], np.int64)
_SQUASH = np.array([max(16, min(4080, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)
_BITS = np.array([i.bit_length() for i in range(MOST)], np.int64)


class Model:
    """The predictions for one id of every block; the same calls code and decode."""

    def __init__(self, lanes: int) -> None:
        self.lane = np.arange(lanes)
        self.ids = [np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)]
        self.sure = [np.zeros(lanes * SLOTS, np.int8), np.zeros(lanes * SLOTS, np.int8)]
        self.rates = np.full((3, lanes * LEVELS), 2048, np.int64)
        self.own = np.full(lanes, 1024, np.int64)
        self.weights = np.full((3, lanes), 24000, np.int64)
        self.counts = np.ones((lanes, KINDS), np.int64)
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)

    def predict(self) -> None:
        at = self.lane * SLOTS
        self.slots = [at + ((self.one * 0x9E3779B1 + self.two * 0x85EBCA6B) >> 7 & SLOTS - 1), at + ((self.one * 0x9E3779B1) >> 9 & SLOTS - 1)]
        self.said = [ids[s].astype(np.int64) for ids, s in zip(self.ids, self.slots)]
        self.conf = [sure[s].astype(np.int64) for sure, s in zip(self.sure, self.slots)]
        self.guess = np.where(self.conf[0] > 0, self.said[0], self.said[1])
        self.rate_at = [self.lane * LEVELS + c for c in self.conf]
        self.p = [self.rates[0][self.rate_at[0]], self.rates[1][self.rate_at[1]], self.own]
        self.st = [_STRETCH[p] for p in self.p]
        dot = (self.weights[0] * self.st[0] + self.weights[1] * self.st[1] + self.weights[2] * self.st[2]) >> 16
        self.mix = _SQUASH[np.clip(dot, -2047, 2047) + 2047]

    def second(self, missed: np.ndarray) -> np.ndarray:
        """Of the blocks that missed, those with another guess by order 1."""
        return missed[(self.conf[1][missed] > 0) & (self.said[1][missed] != self.guess[missed])]

    def second_rate(self, which: np.ndarray) -> np.ndarray:
        return np.clip(self.rates[2][self.rate_at[1][which]], 16, 4080)

    def update(self, ids: np.ndarray, hit: np.ndarray, asked: np.ndarray, right: np.ndarray, plain: np.ndarray, kinds: np.ndarray) -> None:
        error = ((hit.astype(np.int64) << 12) - self.mix) * 6
        for w, s in zip(self.weights, self.st):
            w += (s * error + 0x8000) >> 16
        goal = hit.astype(np.int64) * 4095
        for k in (0, 1):
            self.rates[k][self.rate_at[k]] = self.p[k] + ((goal - self.p[k]) >> 4)
        self.own = self.own + ((goal - self.own) >> 5)
        if len(asked):
            slot = self.rate_at[1][asked]
            old = self.rates[2][slot]
            self.rates[2][slot] = old + ((right.astype(np.int64) * 4095 - old) >> 4)
        if len(plain):
            self.counts[plain, kinds] += 24
            full = plain[self.counts[plain, kinds] > 4000]
            if len(full):
                self.counts[full] = (self.counts[full] + 1) >> 1
        for k in (0, 1):
            same = self.said[k] == ids
            conf = np.where(same, np.minimum(self.conf[k] + 1, LEVELS - 1), self.conf[k] >> 1)
            fresh = ~same & (conf == 0)
            self.ids[k][self.slots[k]] = np.where(fresh, ids, self.said[k])
            self.sure[k][self.slots[k]] = np.where(fresh, 1, conf)
        self.two, self.one = self.one, ids


class Writer:
    def __init__(self, lanes: int, room: int) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.words, self.at = np.zeros((lanes, room), np.uint16), np.zeros(lanes, np.int64)

    def put(self, which: np.ndarray, begin: np.ndarray, size: np.ndarray, part: np.ndarray) -> None:
        """Narrow the ranges of some blocks to [begin, begin + size) of parts of size `part`."""
        low = self.low[which] + part * begin.astype(np.uint64)
        width = part * size.astype(np.uint64)
        self.low[which], self.range[which] = low, width
        while True:
            same = (low ^ (low + width)) < np.uint64(1 << 48)
            out = np.flatnonzero(same | (width < _BOT))
            if not len(out):
                return
            which, low, width, same = which[out], low[out], width[out], same[out]
            width = np.where(same, width, (~low + np.uint64(1)) & (_BOT - np.uint64(1)))
            self.words[which, self.at[which]] = (low >> np.uint64(48)).astype(np.uint16)
            self.at[which] += 1
            low, width = low << np.uint64(16), width << np.uint64(16)
            self.low[which], self.range[which] = low, width

    def finish(self) -> list[np.ndarray]:
        last = (self.low + (_BOT - np.uint64(1))) & ~(_BOT - np.uint64(1))
        for shift in (48, 32):
            self.words[np.arange(len(last)), self.at] = (last >> np.uint64(shift)).astype(np.uint16)
            self.at += 1
        return [w[:n] for w, n in zip(self.words, self.at)]


class Reader:
    def __init__(self, words: list[np.ndarray]) -> None:
        lanes = len(words)
        room = max(map(len, words), default=0) + 8
        self.words, self.at = np.zeros((lanes, room), np.uint64), np.full(lanes, 4, np.int64)
        for i, w in enumerate(words):
            self.words[i, : len(w)] = w
        self.room = room
        self.code = np.zeros(lanes, np.uint64)
        for k in range(4):
            self.code = (self.code << np.uint64(16)) | self.words[:, k]
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def place(self, which: np.ndarray, part: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        return np.minimum(((self.code[which] - self.low[which]) // part).astype(np.int64), total - 1)

    def take(self, which: np.ndarray, begin: np.ndarray, size: np.ndarray, part: np.ndarray) -> None:
        low = self.low[which] + part * begin.astype(np.uint64)
        width = part * size.astype(np.uint64)
        self.low[which], self.range[which] = low, width
        while True:
            same = (low ^ (low + width)) < np.uint64(1 << 48)
            out = np.flatnonzero(same | (width < _BOT))
            if not len(out):
                return
            which, low, width, same = which[out], low[out], width[out], same[out]
            width = np.where(same, width, (~low + np.uint64(1)) & (_BOT - np.uint64(1)))
            self.code[which] = (self.code[which] << np.uint64(16)) | self.words[which, np.minimum(self.at[which], self.room - 1)]
            self.at[which] += 1
            low, width = low << np.uint64(16), width << np.uint64(16)
            self.low[which], self.range[which] = low, width


_SHIFT = np.uint64(12)


def _code(lanes: int, steps: int, ids: np.ndarray | None, words: list[np.ndarray] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Code ids (steps, lanes), or decode the blocks' words into them."""
    writer = Writer(lanes, 2 * steps + 16) if words is None else None
    reader = Reader(words) if words is not None else None
    coder = writer or reader
    out = ids if ids is not None else np.zeros((steps, lanes), np.int64)
    model, every = Model(lanes), np.arange(lanes)
    for t in range(steps):
        now = out[t]
        model.predict()
        hit_size = model.mix
        part = coder.range >> _SHIFT
        if reader:
            hit = reader.place(every, part, 4096) < hit_size
            now = np.where(hit, model.guess, 0)
        else:
            hit = now == model.guess
        (reader.take if reader else writer.put)(every, np.where(hit, 0, hit_size), np.where(hit, hit_size, 4096 - hit_size), part)
        missed = np.flatnonzero(~hit)
        asked = model.second(missed)
        right = np.zeros(0, bool)
        if len(asked):
            rate, part = model.second_rate(asked), coder.range[asked] >> _SHIFT
            if reader:
                right = reader.place(asked, part, 4096) < rate
                now[asked[right]] = model.said[1][asked[right]]
            else:
                right = now[asked] == model.said[1][asked]
            (reader.take if reader else writer.put)(asked, np.where(right, 0, rate), np.where(right, rate, 4096 - rate), part)
            left = np.zeros(lanes, bool)
            left[missed] = True
            left[asked[right]] = False
            plain = np.flatnonzero(left)
        else:
            plain = missed
        kinds = np.zeros(0, np.int64)
        if len(plain):
            sums = np.cumsum(model.counts[plain], axis=1)
            total = sums[:, -1]
            part = coder.range[plain] // total.astype(np.uint64)
            if reader:
                kinds = (sums <= reader.place(plain, part, total)[:, None]).sum(axis=1)
            else:
                kinds = _BITS[now[plain]]
            size = model.counts[plain, kinds]
            (reader.take if reader else writer.put)(plain, sums[np.arange(len(plain)), kinds] - size, size, part)
            free = np.maximum(kinds - 1, 0)
            part = coder.range[plain] >> free.astype(np.uint64)
            if reader:
                rest = reader.place(plain, part, 1 << free)
                now[plain] = np.where(kinds > 0, (1 << free) + rest, 0)
            else:
                rest = np.where(kinds > 0, now[plain] - (1 << free), 0)
            (reader.take if reader else writer.put)(plain, rest, np.ones_like(rest), part)
        if reader:
            out[t] = now
        model.update(now, hit, asked, right, plain, kinds)
    return out, writer.finish() if writer else []


def _checksum(words: np.ndarray, ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(words.astype("<u2").tobytes()))


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A frame of the ids, each below MOST; the last block is filled up with zeros."""
    n = len(ids)
    if n and int(ids.max()) >= MOST:
        raise ValueError(f"ids must be below {MOST}")
    lanes = -(-n // block)
    steps = min(block, n)
    table = np.zeros((lanes, steps), np.int64)
    table.reshape(-1)[:n] = ids
    _, words = _code(lanes, steps, np.ascontiguousarray(table.T), None) if n else (None, [])
    heads = b"".join(struct.pack("<II", len(w), _checksum(w, row)) for w, row in zip(words, table))
    return MAGIC + struct.pack("<QI", n, block) + heads + b"".join(w.astype("<u2").tobytes() for w in words)


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; ValueError where it is damaged."""
    if frame[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    n, block = struct.unpack_from("<QI", frame, 4)
    lanes = -(-n // block)
    heads = np.frombuffer(frame, "<u4", 2 * lanes, 16).reshape(lanes, 2)
    data = np.frombuffer(frame, "<u2", -1, 16 + 8 * lanes)
    if len(data) != heads[:, 0].sum():
        raise ValueError("a frame of token ids is cut off")
    if not n:
        return np.zeros(0, np.uint32)
    words = np.split(data, np.cumsum(heads[:, 0].astype(np.int64))[:-1])
    table = np.ascontiguousarray(_code(lanes, min(block, n), None, words)[0].T)
    for k, row in enumerate(table):
        if _checksum(words[k], row) != heads[k, 1]:
            raise ValueError(f"block {k} of a frame of token ids is damaged")
    return table.reshape(-1)[:n].astype(np.uint32)
