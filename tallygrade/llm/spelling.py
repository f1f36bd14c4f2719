"""Spelling variants: words that differ by one code point, found by pairs of trie nodes.

Every prefix of a word is a node of the trie of words, every suffix one of the trie of reversed words.
A pair (prefix node, suffix node) stands for a word with one place skipped, or with one place between the two:
words with the same pair of skips differ by a replacement, a skip that meets a gap is a deletion. Nodes are
numbered exactly, so equal pairs are neighbours and nothing has to be verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.session import cut

#: Maximal runs of letters: ASCII and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes of at most so many letters are numbered by their letters, deeper ones by a count in the task of their first letters.
SHALLOW = 7


def damaged_runs(documents: DataFrame, least: int = 5, every: int = 97) -> DataFrame:
    """(word): each run of letters with A-Z in lower case, of `least` code points at least.

    Where `every` divides the crc32 h of `<doc_id>:<run>`, the run loses its code point h % length. A null text has
    no runs, a null doc_id counts as the empty text.
    """
    runs = F.filter(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= least)
    each = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    return each.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least: int = 3) -> DataFrame:
    """(id, word, n): words that occur `least` times at least; ids rise in code-point order."""
    counted = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranged = counted.repartitionByRange("word").sortWithinPartitions("word")
    return cut(ranged.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def trie_nodes(words: DataFrame, column: str, out: str) -> DataFrame:
    """(id, out): the numbers of the trie nodes of all prefixes of `column`, the empty one first.

    Words that share their first SHALLOW + 1 letters come to one task in order, which numbers a node when it is
    first seen; only the path of the last word is kept. Letters are one byte each in the numbers of shallow nodes.
    """

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (1 << 62) + (TaskContext.get().partitionId() << 40)
        last, path = "", [0]
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for word in batch.column(column).to_pylist():
                same = 0
                for a, b in zip(last, word):
                    if a != b:
                        break
                    same += 1
                del path[same + 1 :]
                for depth in range(same + 1, len(word) + 1):
                    if depth <= SHALLOW:
                        path.append(path[-1] << 8 | ord(word[depth - 1]))
                    else:
                        count += 1
                        path.append(count)
                last = word
                flat += path
                ends.append(len(flat))
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.record_batch([batch.column("id"), nodes], ["id", out])

    spread = words.select("id", column).repartition(F.substring(column, 1, SHALLOW + 1)).sortWithinPartitions(column)
    return spread.mapInArrow(numbered, f"id long, {out} array<long>")


def pair_rows(words: DataFrame) -> DataFrame:
    """(p, s, id, n, gap, first): the pairs of prefix and suffix nodes of all words (id, word, n).

    gap false: the word without one letter; first: that letter is not the same as the one before it, so that
    a run of equal letters is skipped once. gap true: the two halves of the word.
    """
    both = words.withColumn("reversed", F.reverse("word"))
    nodes = trie_nodes(both, "word", "pre").join(trie_nodes(both, "reversed", "suf"), "id").join(both.select("id", "n", "word"), "id")
    size = F.length("word")
    at = F.sequence(F.lit(0), size)
    entry = F.transform(
        at,
        lambda i: F.struct(
            F.element_at("pre", i + 1).alias("p"), F.element_at("suf", size - i + 1).alias("s"), F.lit(True).alias("gap"), F.lit(False).alias("first")
        ),
    )
    skip = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.element_at("pre", i + 1).alias("p"), F.element_at("suf", size - i).alias("s"), F.lit(False).alias("gap"),
            ((i == 0) | (F.substring(F.col("word"), i + 1, F.lit(1)) != F.substring(F.col("word"), F.greatest(i, F.lit(1)), F.lit(1)))).alias("first"),
        ),
    )
    return nodes.select("id", "n", F.explode(F.concat(entry, skip)).alias("e")).select("e.p", "e.s", "id", "n", "e.gap", "e.first")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many near words each word has, and STRUCT<n, id> of the most frequent; words without any are left out.

    A pair holds at most one word with a gap there and one word per letter of the alphabet without it, so no
    group grows with the table. Two words meet in one pair alone, so counts need no distinct: members of a pair
    count each other, none is joined to itself, and the best of a pair is its first or, for the first itself, its second.
    """
    rank = F.struct((-F.col("n")).alias("n"), F.col("id"))
    group = pair_rows(words).groupBy("p", "s").agg(
        F.array_sort(F.collect_list(F.when(~F.col("gap"), F.struct((-F.col("n")).alias("n"), "id", "first")))).alias("skips"),
        F.min(F.when(F.col("gap"), rank)).alias("whole"),
    )
    group = group.where("size(skips) + IF(whole IS NULL, 0, 1) > 1 AND size(skips) > 0")
    met = F.filter("skips", lambda x: x["first"])
    bare = lambda x: F.struct(x["n"].alias("n"), x["id"].alias("id"))
    group = group.withColumn("met", met)
    of_skip = F.transform(
        "skips",
        lambda x: F.struct(
            x["id"].alias("id"),
            (F.size("skips") - 1 + F.when(x["first"] & F.col("whole").isNotNull(), 1).otherwise(0)).alias("k"),
            F.least(
                F.when(x["id"] != F.col("skips")[0]["id"], bare(F.col("skips")[0])).when(F.size("skips") > 1, bare(F.get(F.col("skips"), F.lit(1)))),
                F.when(x["first"], F.col("whole")),
            ).alias("best"),
        ),
    )
    of_whole = F.when(
        F.col("whole").isNotNull() & (F.size("met") > 0),
        F.array(F.struct(F.col("whole.id").alias("id"), F.size("met").alias("k"), bare(F.get(F.col("met"), F.lit(0))).alias("best"))),
    ).otherwise(F.slice(of_skip, 1, 0))
    members = group.select(F.explode(F.concat(of_skip, of_whole)).alias("m")).where("m.k > 0")
    return members.groupBy("m.id").agg(F.sum("m.k").alias("n_near"), F.min("m.best").alias("best")).select(
        "id", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.id").alias("id")).alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where the chain id -> form ends; form is null at its end. Forms are at least twice as frequent, so there is no ring.

    Pointers are doubled until none moves: a chain of k forms takes log2(k) rounds.
    """
    now = cut(forms.select("id", F.coalesce("form", "id").alias("root")), "roots")
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("further")).where("root <> further")
        moved = now.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        now = cut(moved, "roots")
        if now.where("moved").isEmpty():
            return now.select("id", "root")


def spelling_groups(words: DataFrame, least: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs `least` times at least in words (word).

    A word's form is its near word with the largest n (ties: the smallest in code-point order) if that n is
    `times` the word's at least, else null; root is the end of the chain of forms, the word itself without one.
    Null and empty words are left out, repeated rows are the counts; an empty table gives an empty table. Letters have
    code points below 256; words may be of any length, rows grow with it in proportion.
    """
    known = vocabulary(words, least)
    joined = known.join(near_words(known), "id", "left")
    takes = F.col("best.n") >= times * F.col("n")
    found = cut(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.id")).alias("form"), F.when(takes, F.col("best.n")).alias("form_n")), "forms")
    name = known.select("id", "word")
    return (
        found.join(roots(found), "id")
        .join(name.toDF("form", "form_word"), "form", "left")
        .join(name.toDF("root", "root_word"), "root", "left")
        .select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    )
