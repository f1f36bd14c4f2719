"""Benchmark decontamination: prefix-filtered set join, DataFrame functions only.

A benchmark window is the set of its word shingles, each with its place. Containment
is exact, so a window's prefix is one token: its rarest shingle, by counts over all
documents. A document position with that shingle is a candidate; length and position
bound where the window can lie, and the words themselves are compared.

The words of a document are read in one scan. A byte array of fixed size (`SLOTS`),
made from the benchmark's shingles, lets only positions through that may hold one;
it never grows, and what it lets through by chance goes in the join. With a larger
benchmark it lets more through, nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.session import cut

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLOTS = 1 << 20
SHINGLE = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words between separators, A-Z in lower case; null texts have none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1)
    return F.filter(parts, lambda w: w != "")


def _shingle(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + j) for j in range(size)])


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, w, m): the windows of every item as text, and their number of words.

    Rows without item_id or words have no window.
    """
    items = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0")
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - size + 1)))
    windows = items.select("item_id", "words", F.least("n", F.lit(size)).alias("m"), first.alias("at"))
    return windows.select("item_id", F.array_join(F.slice("words", F.col("at"), F.col("m")), " ").alias("w"), "m").distinct()


def window_shingles(windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """(w, m, o, h): the shingles of each distinct window with their place in it."""
    rows = windows.select("w", "m").distinct().withColumn("words", F.split("w", " "))
    parts = []
    for s in sizes:
        mine = rows.where(F.least("m", F.lit(shingle)) == s)
        mine = mine.select("w", "m", "words", F.explode(F.sequence(F.lit(0), F.col("m") - s)).alias("o"))
        parts.append(mine.select("w", "m", "o", _shingle("words", F.col("o"), s).alias("h")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _marks(shingles: DataFrame) -> Column:
    """A literal of SLOTS bytes, one for each slot that a shingle falls in."""
    taken = shingles.select(F.col("h").bitwiseAND(SLOTS - 1).alias("at")).distinct().collect()  # at most SLOTS numbers
    held = bytearray(SLOTS)
    for r in taken:
        held[r["at"]] = 1
    return F.lit(bytes(held))


def _seen(marks: Column, h: Column) -> Column:
    return F.substring(marks, (h.bitwiseAND(SLOTS - 1) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")


def positions(documents: DataFrame, marks: Column, sizes: list[int], size: int) -> DataFrame:
    """One row per document (at = -1, its number of words n), and one per position that may hold a shingle.

    near: the words from `size` - 1 before the position on, begins: the first one's place.
    """
    docs = documents.select("doc_id", F.xxhash64("text").alias("k"), words_of(F.col("text")).alias("words"))
    docs = docs.withColumn("n", F.size("words"))
    rows = docs.select("doc_id", "k", "n", "words", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("at"))
    at, parts = F.col("at"), []
    hashes = [F.when((at >= 0) & (at + s <= F.col("n")), _shingle("words", at, s)) for s in sizes]
    rows = rows.select("doc_id", "k", "n", "words", "at", *[h.alias(f"h{s}") for s, h in zip(sizes, hashes)])
    some = at == -1
    for s in sizes:
        some = some | _seen(marks, F.col(f"h{s}"))
        parts.append(F.col(f"h{s}"))
    begins = F.greatest(at - size + 1, F.lit(0))
    return rows.where(some).select(
        "doc_id", "k", "n", "at", F.array(*parts, F.lit(None).cast("bigint")).alias("hs"), begins.alias("begins"),
        F.when(at >= 0, F.slice("words", begins + 1, F.lit(2 * size))).alias("near"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """What benchmark items each document (doc_id, text) holds.

    doc_id, n_words, n_hit (words inside an occurrence of a window), n_items,
    items_sha256 (of the item ids sorted as texts), contaminated (n_hit > 0), for every
    row. A window has `size` consecutive words of an item; an item of fewer words is one
    window. Null texts have no words. Rows of the benchmark without id are left out, as
    are items without words; equal items each count. Rows with a null doc_id and repeated
    rows get their own answer. An empty benchmark hits nothing. Other columns are not read.
    """
    windows = benchmark_windows(benchmark, size)
    sizes = sorted(r[0] for r in windows.select(F.least("m", F.lit(SHINGLE))).distinct().collect())
    if not sizes:
        sizes = [SHINGLE]
    shingles = window_shingles(windows, sizes, SHINGLE)
    seen = cut(positions(documents, _marks(shingles), sizes, size), "positions")
    found = seen.where("at >= 0").select("doc_id", "k", "n", "at", "begins", "near", F.explode("hs").alias("h")).where("h is not null")
    # the rarest shingle of each window; windows with one that no document holds occur nowhere
    counts = found.groupBy("h").agg(F.count("*").alias("c"))
    ranked = shingles.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    prefix = ranked.groupBy("w", "m").agg(F.min(F.struct("c", "o", "h")).alias("p")).where("p.c > 0").select("w", "m", "p.o", "p.h")
    hits = found.join(prefix, "h").withColumn("start", F.col("at") - F.col("o"))
    hits = hits.where("start >= 0 and start + m <= n and start >= begins")
    hits = hits.where(F.array_join(F.slice("near", F.col("start") - F.col("begins") + 1, F.col("m")), " ") == F.col("w"))
    hits = hits.select("doc_id", "k", "start", (F.col("start") + F.col("m")).alias("stop"), "w").join(windows.select("w", "item_id"), "w")
    item = F.col("item_id").cast("string")
    answer = hits.groupBy("doc_id", "k").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"), F.sort_array(F.collect_set(item)).alias("items"))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grown = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(a["end"], r["start"]))).alias("n"), F.greatest(a["end"], r["stop"]).alias("end"))
    covered = F.aggregate("runs", nothing, grown, lambda a: a["n"])
    answer = answer.select(F.col("doc_id").alias("i"), F.col("k").alias("ik"), covered.alias("n_hit"), "items")
    docs = seen.where("at = -1").select("doc_id", "k", "n")
    docs = docs.join(answer, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("ik")), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return docs.select(
        "doc_id", F.col("n").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs; those with a null doc_id are judged by their text too."""
    marked = contamination(documents.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, size)
    bad = marked.where("contaminated").select(F.col("doc_id").alias("k_")).distinct()
    given = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row_"), F.xxhash64("text").alias("k_"))
    return given.join(bad, "k_", "left_anti").select("row_.*")  # the caller's columns are fields of one, so that none can clash
