"""Token ids of many texts with the tokenizers library, each distinct stretch encoded once.

Both vocabularies cut a text into stretches before they merge anything, and never
across a single space between two characters that are not white space (or, where
white space is dropped, never across white space). So texts are cut there, every
distinct piece of a slice is encoded once, and the ids are put together again:
the same ids as those of the whole text.
"""

from __future__ import annotations

import os
import sys
import types
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallygrade.llm.texts import filled, split_words

SLICE_BYTES = 32 << 20
CHUNK, STRETCHES = 1 << 13, 1 << 18
#: Pieces whose ids a Python worker keeps; one slice may go over it once.
KEPT = 200_000
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
_UNSURE = rf"[{_SPACE}] | [{_SPACE}]|^ | $"


def kept(name: str, make: Callable[[], object]):
    """An object that stays in a Python worker from one task to the next, made where it is missing."""
    module = sys.modules.setdefault("tallygrade_worker", types.ModuleType("tallygrade_worker"))
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


def load(path: str):
    """The tokenizer in a vocabulary file; one thread, as Spark has its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return kept(f"tokenizer {path}", lambda: Tokenizer.from_file(path))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts, one behind the other."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    for at in range(0, len(lengths), STRETCHES):  # the index takes more memory than the ids
        begin, size = starts[at : at + STRETCHES], lengths[at : at + STRETCHES]
        end = np.cumsum(size)
        to = int(ends[at] - lengths[at])
        out[to : to + int(end[-1])] = flat[np.repeat(begin - (end - size), size) + np.arange(int(end[-1]))]
    return out


def _table(tokenizer, pieces: list[str], often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and how many each has.

    often: which pieces are likely to come again; their ids stay in the worker, up to
    `KEPT` of them, so that later slices and tasks need not encode them.
    """
    known: dict[str, bytes] = kept(f"pieces {id(tokenizer)}", dict)
    found = list(map(known.get, pieces))
    missing = [i for i, f in enumerate(found) if f is None]
    for at in range(0, len(missing), CHUNK):  # an encoding takes far more memory than its ids
        some = missing[at : at + CHUNK]
        for i, e in zip(some, tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
            found[i] = array("I", e.ids).tobytes()
    if often is not None and len(known) < KEPT:
        known.update((pieces[i], found[i]) for i in missing if often[i])
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // array("I").itemsize
    return np.frombuffer(b"".join(found), np.uint32), lengths


def _careful(text: str) -> list[str]:
    """Pieces of a text with runs of white space: cut only at single spaces between other characters."""
    out: list[str] = []
    for i, part in enumerate(text.split(" ")):
        piece = part if i == 0 else " " + part
        if i and part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(piece)
        elif i:
            out[-1] += piece
        else:
            out.append(piece)
    return out


def encoded(tokenizer, texts: pa.Array, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text); null texts are empty.

    spaces: whether the vocabulary keeps white space.
    """
    texts = filled(texts)
    if not spaces:
        # the vocabulary has no capitals; a mark of its own in a text is known by its exact letters
        words = split_words(texts, lower=not pc.any(pc.match_substring(texts, "<|")).as_py())
        often = np.bincount(words.ids, minlength=len(words.uniques)) > 1
        flat, lengths = _table(tokenizer, words.uniques.to_pylist(), often)
        begins = np.cumsum(lengths) - lengths
        index, owner = words.ids, words.text_of()
    else:
        unsure = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False)
        plain = texts if not unsure.any() else pc.if_else(pa.array(unsure), "", texts)
        lists = pc.split_pattern(plain, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        uniques = coded.dictionary.to_pylist()
        first = np.cumsum(counts) - counts
        heads = dict.fromkeys(uniques[i] for i in index[first].tolist())
        place = {h: len(uniques) + i for i, h in enumerate(heads)}
        index = index.copy()
        index[first] = [place[uniques[i]] for i in index[first].tolist()]
        pieces = [" " + u for u in uniques] + list(heads)
        if unsure.any():
            more = [(i, _careful(texts[i].as_py())) for i in np.flatnonzero(unsure).tolist()]
            known: dict[str, int] = {}
            late = [known.setdefault(p, len(known)) + len(pieces) for _, parts in more for p in parts]
            pieces += list(known)
            keep = ~unsure[owner]
            index = np.concatenate([index[keep], np.array(late, np.int64)])
            owner = np.concatenate([owner[keep], np.repeat([i for i, _ in more], [len(p) for _, p in more])])
            order = np.argsort(owner, kind="stable")
            index, owner = index[order], owner[order]
        often = np.bincount(index, minlength=len(pieces)) > 1
        flat, lengths = _table(tokenizer, pieces, often)
        begins = np.cumsum(lengths) - lengths
    sizes = lengths[index] if len(index) else np.zeros(0, np.int64)
    ids = gather(flat, begins[index], sizes) if len(index) else np.zeros(0, np.uint32)
    return ids, np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with an end id behind them."""
    return np.insert(ids, np.cumsum(counts), end).astype(np.uint32), counts + 1
