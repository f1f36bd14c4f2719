"""N-gram Jaccard join: grouped prefix join over sets of word shingles.

Texts with equal sets become one unit, units with equal prefixes and size one
group. Groups that share a prefix token are compared by size and position, their
members by parity bits; only what is left is verified on the whole sets, which are
made again from the texts of those documents alone.

Links are wanted for components, so pairs are tried in two passes. First every
group meets the leader of each of its buckets, and every member the leader of its
group: as many pairs as index rows. Then only pairs that still lie in different
components are tried, found on the level of (token, component). A group of many
near copies is one component after the first pass and makes no pairs of its own.

Any order of the tokens gives right results, as long as it depends on the token alone.
Rare shingles come first, by counts over all texts: the `HEAVY` most frequent shingles
last, by their number; all others by how frequent their words are, for which the
`HEAVY` most frequent words have a number. These bounds only move work; they drop
nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade import session
from tallygrade.llm.links import components
from tallygrade.llm.texts import filled, hashed, mixed, signed, slices, split_words, windows

#: The steps are many and large: their shuffles go as soon as their table is written.
cut = partial(session.cut, free_shuffles=True)

HEAVY = 1 << 17
#: Bytes of text in a slice, and words whose counts are reported together.
SLICE, FLUSH = 4 << 20, 1 << 20
BITS = 1024
#: Numbers of 64 bits that the parity bits are folded to where groups are joined.
FOLDS = 4
SPACE = " \t\n\x0b\x0c\r"


def shingles_of(texts: pa.Array, words: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and the index of the first word of each.

    Also the hashes of all words in a row, and of the distinct words. Texts with fewer
    words have their whole sequence as one shingle, texts without words or null none.
    """
    split = split_words(filled(texts), lower=True)
    known = hashed(split.uniques)
    of = known[split.ids] if len(split.ids) else np.zeros(0, np.uint64)
    found, first = windows(of, split.starts, words)
    cuts = np.searchsorted(first, split.starts)
    sets, places = [], []
    for i, n in enumerate(split.counts):
        at = split.starts[i]
        if n >= words:
            one, where = np.unique(found[cuts[i] : cuts[i + 1]], return_index=True)
            sets.append(one)
            places.append(first[cuts[i] + where])
        elif n:
            sets.append(np.array([xxhash.xxh3_64_intdigest(of[at : at + n].tobytes(), 7)], np.uint64))
            places.append(np.array([at]))
        else:
            sets.append(np.zeros(0, np.uint64))
            places.append(np.zeros(0, np.int64))
    return sets, places, of, known


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    return shingles_of(texts, words)[0]


def marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets have equal marks."""
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    ends = np.cumsum([len(s) for s in sets], dtype=np.int64)
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat + np.uint64(salt)), dtype=np.uint64)])
        total = sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(np.int64)]
        out.append(signed(mixed(total + np.uint64(salt))))
    return out[0], out[1]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set BITS bits, as signed 64-bit numbers: whether a slot holds an odd number of its hashes."""
    out = np.zeros((len(sets), BITS // 8), np.uint8)
    for i, s in enumerate(sets):
        slots = ((s >> np.uint64(24)) & np.uint64(BITS - 1)).astype(np.int64)
        out[i] = np.packbits((np.bincount(slots, minlength=BITS) & 1).astype(bool))
    return np.frombuffer(out.tobytes(), np.int64)


def frequent(documents: DataFrame, words: int, most: int = HEAVY) -> list[tuple[np.ndarray, np.ndarray]]:
    """The most frequent shingles and words, each sorted with their counts, from counts over all texts.

    A task reports what it saw at least twice in a stretch.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                often = counts > 1
                kinds = np.full(int(often.sum()), kind, np.int32)
                yield pa.record_batch([pa.array(kinds), pa.array(signed(values[often])), pa.array(counts[often].astype(np.int64))], ["kind", "token", "n"])

        size = 0
        for part in slices(batches, "text", SLICE):
            sets, _, of, _ = shingles_of(part.column("text"), words)
            held[0] += sets
            held[1].append(of)
            size += len(of)
            if size > FLUSH:
                yield from flush()
                size = 0
        if held[1]:
            yield from flush()

    rows = documents.select("text").mapInArrow(counted, "kind int, token long, n long")
    rows = cut(rows.groupBy("kind", "token").agg(F.sum("n").alias("n")), "frequent")
    out = []
    for kind in (0, 1):
        top = rows.where(F.col("kind") == kind).orderBy(F.desc("n"), "token").limit(most).select("token", "n").toArrow()
        values = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(values)
        out.append((values[order], top.column("n").to_numpy()[order]))
    return out


def _number(table: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """How often each token occurs by the table, 0 where it has none."""
    values, counts = table
    if not len(values):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
    return np.where(values[at] == tokens, counts[at], 0)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(documents: DataFrame, words: int, percent: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Per document its text's hash, its set's size and marks, and the prefix: its rarest shingles, rarest first."""
    shared = documents.sparkSession.sparkContext.broadcast(tables)  # 2 * HEAVY numbers each

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, common = shared.value
        values, counts = heavy
        seen = np.zeros(1 << 20, bool)
        seen[(values & np.uint64(len(seen) - 1)).astype(np.int64)] = True
        for part in slices(batches, "text", SLICE):
            sets, places, of, known = shingles_of(part.column("text"), words)
            order = np.argsort(known)
            known, numbers = known[order], _number(common, known[order])
            weight = np.log2(numbers + 1.0)[np.searchsorted(known, of)] if len(of) else np.zeros(0)
            sums = np.concatenate([[0.0], np.cumsum(np.round(weight * 4))])
            a, b = marks(sets)
            chosen, keys = [], []
            for s, place in zip(sets, places):
                p = prefix_length(len(s), percent) if len(s) else 0
                rank = sums[np.minimum(place + words, len(of))] - sums[place]
                maybe = np.flatnonzero(seen[(s & np.uint64(len(seen) - 1)).astype(np.int64)])
                if len(maybe):
                    often = _number(heavy, s[maybe])
                    rank[maybe] += np.where(often, 1e6 + often, 0)
                light = s[np.argsort(rank, kind="stable")[:p]]
                chosen.append(light)
                keys.append(xxhash.xxh3_64_intdigest(light.tobytes(), len(s)))
            flat = np.concatenate([*chosen, np.zeros(0, np.uint64)])
            ends = np.concatenate([[0], np.cumsum([len(c) for c in chosen])]).astype(np.int32)
            yield pa.record_batch(
                [
                    part.column("doc_id").cast(pa.int64()),
                    part.column("t"),
                    pa.array(np.array([len(s) for s in sets], np.int64)),
                    pa.array(a),
                    pa.array(b),
                    pa.array(signed(np.array(keys, np.uint64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(flat))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)), pa.array(parities(sets))),
                ],
                ["doc_id", "t", "n", "a", "b", "g", "prefix", "bits"],
            )

    kinds = "doc_id long, t long, n long, a long, b long, g long, prefix array<long>, bits array<long>"
    return documents.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(made, kinds)


def whole_sets(documents: DataFrame, words: int) -> DataFrame:
    """(u, s): each document's first mark and its whole set."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            sets = sets_of(part.column("text"), words)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate([*sets, np.zeros(0, np.uint64)]))))
            yield pa.record_batch([pa.array(marks(sets)[0]), lists], ["u", "s"])

    return documents.select("text").mapInArrow(made, "u long, s array<long>")


def possible(pairs: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """Those pairs (x, y) of units that the parity bits don't rule out.

    Each slot in which two sets differ holds a hash that only one of them has, so the
    sets have at most (nx + ny - differing slots) / 2 hashes in common.
    """
    one = units.select(F.col("u").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    two = units.select(F.col("u").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    slots = F.zip_with("bx", "by", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.aggregate(slots, F.lit(0), lambda total, k: total + k)
    both = F.col("nx") + F.col("ny")
    fits = _sizes_fit("nx", "ny", percent) & ((100 + percent) * (both - differ) >= 2 * percent * both)
    return pairs.join(one, "x").join(two, "y").where(fits).select(*pairs.columns)


def verified(pairs: DataFrame, units: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (x, y) whose whole sets are as similar as asked for; the sets are made again for them alone."""
    asked = pairs.select(F.col("x").alias("u")).unionByName(pairs.select(F.col("y").alias("u"))).distinct()
    needed = units.join(asked, "u", "left_semi").select(F.col("doc").alias("doc_id")).distinct()
    sets = cut(whole_sets(documents.join(needed, "doc_id", "left_semi"), words), "sets")
    sides = pairs.join(sets.select(F.col("u").alias("x"), F.col("s").alias("sx")), "x").join(
        sets.select(F.col("u").alias("y"), F.col("s").alias("sy")), "y"
    )
    common = F.size(F.array_intersect("sx", "sy"))
    both = F.size("sx") + F.size("sy") - common
    return sides.where(100 * common >= percent * both).select(*pairs.columns)


def _band(percent: int) -> Column:
    """Sizes that fit each other are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.0001)).cast("int")


def _sizes_fit(x: str, y: str, percent: int) -> Column:
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def _alike(x: str, y: str, percent: int) -> Column:
    """False where the folded bits of two sets of sizes x and y rule them out; sets without them go on to their members' bits."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"f{i}x").bitwiseXOR(F.col(f"f{i}y"))) for i in range(FOLDS)])
    both = F.col(x) + F.col(y)
    return F.coalesce((100 + percent) * (both - differ) >= 2 * percent * both, F.lit(True))


def _largest(percent: int) -> Column:
    """How large the other set may be for a pair to have its first common token at this place.

    Two sets that are similar enough have c >= percent * (nx + ny) / (100 + percent) hashes
    in common, and so a common token among the first n - c + 1 of each.
    """
    return F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent).cast("long") - F.col("n")


def _folded() -> list[Column]:
    """The parity bits of a set folded to FOLDS numbers: the same test with fewer slots."""
    words = [F.col("bits")[i] for i in range(BITS // 64)]
    return [reduce(Column.bitwiseXOR, words[i::FOLDS]) for i in range(FOLDS)]


def labelled(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, t, n, c) for every row of documents (doc_id, text): its text's hash, its number of shingles, its component.

    c is the mark of one of the component's sets; null where a row links with nothing: without shingles or doc_id. See `jaccard_components`.
    """
    documents = documents.select("doc_id", "text")
    docs = cut(prefixes(documents, words, percent, frequent(documents, words)), "prefixes")
    usable = docs.where("doc_id is not null and n > 0")
    alike = usable.groupBy("n", "g", F.col("a").alias("u"), "b").agg(F.min("doc_id").alias("doc"), F.any_value("bits").alias("bits"))
    units = cut(alike.drop("b"), "units")

    # the index: tokens that two groups share, and one row for each group of several units
    groups = usable.groupBy("n", "g").agg(F.min("a").alias("gid"), F.max("a").alias("last"), F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits"))
    groups = cut(groups.select("n", "g", "gid", "last", "prefix", *[F.when(F.col("gid") == F.col("last"), folded).alias(f"f{i}") for i, folded in enumerate(_folded())]), "groups")
    tokens = groups.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    index = tokens.join(shared, "token").select("token", "gid", "n", "pos")
    own = groups.where("gid <> last").select(F.xxhash64(F.lit("group"), "gid").alias("token"), "gid", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))
    index = index.unionByName(own).withColumn("band", _band(percent)).withColumn("largest", _largest(percent))
    index = cut(index, "index")
    several = groups.where("gid <> last").select("n", "g", "gid")
    members = units.join(several, ["n", "g"]).select("gid", "u")
    alone = groups.where("gid = last").select("gid", F.col("gid").alias("u"))
    members = members.unionByName(alone).join(index.select("gid").distinct(), "gid", "left_semi")
    members = cut(members, "members")

    # first pass: leaders
    early = F.struct((F.col("largest") < F.col("n")).alias("late"), F.col("gid").alias("y"), F.col("n").alias("ny"), F.col("largest").alias("ly"))
    lead = index.groupBy("token", "band").agg(F.min(early).alias("lead"), F.count("*").alias("k")).where("k > 1").select("token", "band", "lead.*")
    led = index.join(lead, ["token", "band"]).where("gid <> y and largest >= ny and ly >= n").select(F.col("gid").alias("x"), "y")
    led = led.unionByName(members.where("u <> gid").select(F.col("u").alias("x"), F.col("gid").alias("y")))
    led = cut(possible(led.distinct(), units, percent), "led")
    near = cut(verified(led, units, documents, words, percent), "near")
    first = cut(components(near), "first")

    # second pass: pairs of different components
    placed = members.join(first.withColumnRenamed("node", "u"), "u", "left").select("gid", "u", F.coalesce("component", "u").alias("comp"))
    placed = cut(placed, "placed")
    folds = [f"f{i}" for i in range(FOLDS)]
    rows = index.join(placed.select("gid", "comp").distinct(), "gid")
    mixed_tokens = rows.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
    rows = rows.join(mixed_tokens, "token", "left_semi").join(groups.select("gid", *folds), "gid")
    rows = cut(rows, "mixed")
    # Where a component has one group with a token, and that is one set, its folded bits stand for it.
    alone = lambda f: F.when(F.count("*") == 1, F.any_value(f)).alias(f)
    per = rows.groupBy("token", "band", "comp").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("largest").alias("largest"), F.count("*").alias("k"), *[alone(f) for f in folds]
    )
    per = cut(per, "per")
    side = lambda df, end: df.select(
        "token", F.col("band").alias(f"b{end}"), F.col("comp").alias(f"c{end}"), *[F.col(c).alias(f"{c}{end}") for c in ("lo", "hi", "largest", "k", *folds)]
    )
    ahead = side(per, "x").withColumn("band", F.explode(F.array("bx", F.col("bx") + 1)))
    behind = side(per, "y").withColumn("band", F.col("by"))
    pairs = ahead.join(behind, ["token", "band"]).where(
        (F.col("cx") != F.col("cy"))
        & ((F.col("bx") < F.col("by")) | (F.col("cx") < F.col("cy")))
        & (100 * F.col("hix") >= percent * F.col("loy"))
        & (100 * F.col("hiy") >= percent * F.col("lox"))
        & (F.col("largestx") >= F.col("loy"))
        & (F.col("largesty") >= F.col("lox"))
        & _alike("lox", "loy", percent)
    )
    # The side with fewer groups comes first: what is between the two joins grows with the pairs of components alone.
    turned = F.col("kx") > F.col("ky")
    ends = [F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("bx", "by"), ("cx", "cy"), ("by", "bx"), ("cy", "cx"))]
    pairs = pairs.select("token", *ends)
    whole = lambda end: rows.select(
        "token", F.col("band").alias(f"b{end}"), F.col("comp").alias(f"c{end}"), F.col("gid").alias(f"g{end}"), F.col("n").alias(f"n{end}"), F.col("largest").alias(f"l{end}"),
        *[F.col(f).alias(f"{f}{end}") for f in folds],
    )
    tried = pairs.join(whole("x"), ["token", "bx", "cx"]).join(whole("y"), ["token", "by", "cy"])
    tried = tried.where(_sizes_fit("nx", "ny", percent) & (F.col("lx") >= F.col("ny")) & (F.col("ly") >= F.col("nx")) & _alike("nx", "ny", percent))
    tried = tried.select("gx", "cx", "gy", "cy").distinct()
    tried = tried.join(placed.select(F.col("gid").alias("gx"), F.col("comp").alias("cx"), F.col("u").alias("x")), ["gx", "cx"])
    tried = tried.join(placed.select(F.col("gid").alias("gy"), F.col("comp").alias("cy"), F.col("u").alias("y")), ["gy", "cy"])
    tried = cut(possible(tried.select("x", "y", "cx", "cy").distinct(), units, percent), "tried")
    found = tried if tried.isEmpty() else verified(tried, units, documents, words, percent)
    second = components(cut(found.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct(), "joined"))

    label = units.select("u", "doc").join(first.withColumnRenamed("node", "u"), "u", "left")
    label = label.select("u", "doc", F.coalesce("component", "u").alias("c1"))
    label = label.join(second.withColumnRenamed("node", "c1"), "c1", "left").select("u", "doc", F.coalesce("component", "c1").alias("c"))
    label = label.select(F.col("u").alias("a"), "c")
    alike = usable.select("doc_id", "t", "n", "a").join(label, "a").select("doc_id", "t", "n", "c")
    rest = docs.where("doc_id is null or n = 0").select("doc_id", "t", "n", F.lit(None).cast("long").alias("c"))
    return cut(alike.unionByName(rest), "labelled")


def jaccard_components(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text).

    Two texts link when 100 * common >= percent * all of their distinct shingles of
    `words` words; component_id is the least doc_id reachable, itself included.
    Null and empty texts have no shingles and stand alone. Rows whose doc_id is null
    come back with a null component and link with nothing. Repeated rows are copies
    of each other and each come back. Columns besides doc_id and text are not read.
    """
    rows = labelled(documents, words, percent)
    least = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component"))
    found = rows.join(least, "c", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the row with the least doc_id.

    Rows with one doc_id and different texts are different documents; of rows with equal doc_id and text one stays.
    Empty texts stay. Rows with a null doc_id are compared by their whole text alone: one stays of each text
    that no row with a doc_id has. All columns come back, whatever their names; an empty table gives an empty table.
    """
    text = F.xxhash64("text")
    rows = labelled(documents, words, percent)
    named = rows.where("doc_id is not null")
    kept = named.where("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("k")).select("k.doc_id", "k.t")
    kept = kept.unionByName(named.where("c is null").select("doc_id", "t").distinct())
    kept = kept.select(F.struct("doc_id", "t").alias("_stays"))
    given = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    stay = documents.select(given, key.alias("_key")).join(kept, F.col("_key") == F.col("_stays"), "left_semi").dropDuplicates(["_key"])
    nameless = documents.where("doc_id is null").select(given, text.alias("t"), F.coalesce(F.trim("text", F.lit(SPACE)), F.lit("")).alias("words"))
    again = named.where("n > 0").select("t").distinct()
    single = nameless.where("words <> ''").join(again, "t", "left_anti").dropDuplicates(["t"])
    return stay.select("_row.*").unionByName(nameless.where("words = ''").select("_row.*")).unionByName(single.select("_row.*"))
