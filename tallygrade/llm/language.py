"""Language ID by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.llm.texts import filled, slices

#: Bytes of a language's dictionary at most, and characters that one document gives to it.
DICTIONARY = 1 << 17
EXCERPT = 512
#: Bytes of text that are compressed at a time, so that the dictionary counts in long texts too.
BLOCK = 1024
#: A prediction is rejected when the next language needs less than this share of bytes more.
MARGIN = 0.005
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2


def fold(column: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % folds


def dictionaries(documents: DataFrame, size: int = DICTIONARY) -> list[tuple[str, bytes]]:
    """Per language (most frequent first) a raw-content dictionary from the documents to learn from.

    Of every language as many documents as fill the dictionary are chosen by a hash of
    their id, and each gives an excerpt from a place chosen the same way.
    """
    learn = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    learn = learn.where(fold("doc_id", FOLDS) != HELD_OUT)
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return []
    wanted = size // EXCERPT
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 24))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, min(1 << 24, (wanted << 25) // n)))])
    chosen = learn.where(place < F.element_at(share, F.col("lang"))).select("lang", place.alias("place"), "doc_id", "text")
    begin = F.pmod(F.xxhash64("doc_id", "place"), F.greatest(F.lit(1), F.char_length("text") - EXCERPT + 1)).cast("int")
    chosen = chosen.select("lang", "place", "doc_id", F.substring("text", begin + 1, F.lit(EXCERPT)).alias("piece"))
    held: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in sorted(chosen.collect(), key=lambda r: (r["place"], r["doc_id"], r["piece"])):  # about twice `size` bytes a language
        held[r["lang"]].append(r["piece"].lower().encode())
    return [(lang, b" ".join(held[lang])[:size]) for lang in sorted(counts, key=lambda x: (-counts[x], x))]


def compressors(known: list[tuple[str, bytes]]) -> list:
    import zstandard

    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=3, window_log=19, hash_log=17, chain_log=17, search_log=2, write_content_size=False
    )
    raw = zstandard.DICT_TYPE_RAWCONTENT
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), compression_params=how) for _, d in known]


def sizes(text: str, coders: list) -> np.ndarray:
    """Bytes of the whole text in the dictionary of every language, block by block."""
    data = text.lower().encode()
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in coders])


def language_id(documents: DataFrame, size: int = DICTIONARY, margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of documents (doc_id, text, lang).

    lang_pred is the learned language with the smallest code, of equal ones the most
    frequent; `und` for null texts, texts without a letter, and when nothing could be
    learned. score weighs the sizes (each byte more divides a language's weight by two,
    up to 64 bytes); rejected says that the margin is narrow, and is true for `und`.
    held_out documents, those whose crc32 of doc_id has remainder 2 by 4, and rows with a
    null doc_id, text or lang are not learned from; lang is read for nothing else. Every
    row gets its answer, repeated ones too.
    """
    known = dictionaries(documents, size)
    shared = documents.sparkSession.sparkContext.broadcast(known)  # `size` bytes a language

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [lang for lang, _ in shared.value]
        coders = compressors(shared.value)
        for part in slices(batches, "text"):
            texts = filled(part.column("text"))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            pred, score, rejected = [], [], []
            for text, usable in zip(texts.to_pylist(), letters.tolist()):
                if not usable or not names:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                got = sizes(text, coders)
                best = int(got.argmin())
                over = np.minimum(got - got[best], 64)
                rest = np.delete(got, best)
                pred.append(names[best])
                score.append(float(1 / np.exp2(-over.astype(float)).sum()))
                rejected.append(bool(len(rest) and rest.min() - got[best] < margin * got[best]))
            out = [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.record_batch(out, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = (F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) == HELD_OUT)).alias("held_out")
    return documents.select("doc_id", held, "text").mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
