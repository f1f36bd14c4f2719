"""Arrow helpers shared by the operators of this folder: bounded slices, words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 16 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.random.default_rng(20).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def give_back() -> None:
    """Return to the system what was freed: a worker stays for later tasks, and what it keeps is taken from its executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about `limit` bytes; a longer text stands alone.

    After the last one the worker's freed memory is given back.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def filled(texts: pa.Array) -> pa.Array:
    """Texts with empty ones for nulls, with offsets that start at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and where each text begins; texts come from `filled`."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """The words of many texts: word k is uniques[ids[k]]; text i has words starts[i] to starts[i + 1]."""

    ids: np.ndarray
    uniques: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts from `filled`; lower: with A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(keep).as_py():
        owner = np.repeat(np.arange(len(lengths)), lengths)[keep.to_numpy(zero_copy_only=False)]
        lengths = np.bincount(owner, minlength=len(lengths))
        flat = flat.filter(keep)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(ids, coded.dictionary, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))


def hashed(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings."""
    raw = values.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw, repeat(seed)), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit numbers spread over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one text, and the index of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(starts[1:], np.diff(starts))
    first = np.flatnonzero(np.arange(n) + size <= ends[:n])
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * _ODD[j]
    return mixed(total[first] + np.uint64(size)), first


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
