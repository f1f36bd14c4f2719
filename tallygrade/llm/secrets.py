"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

DataFrame functions only. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrade.session import cut

# The kinds in their order, their patterns and the least length of what they find.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{12,}"
#: What labels a string as an ordinary identifier: words in one case, joined by marks or capitals, and a short number.
ORDINARY = "^[A-Z]?[a-z]+(?:[-_/=+][A-Z]?[a-z]+|[A-Z][a-z]+)*[-_/=+]*[0-9]{0,4}$|^[A-Z]+(?:[-_][A-Z]+)*$"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIDE = len(ALPHABET) + 1
GENERATED = 4096
LEAST = 16
MARGIN = 0.35
PRIOR = 5.0


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, k, kind, at, start, stop, hit, clear): what the patterns find.

    kind 0 to 2: base spans of the lengths asked for; 3: other strings of 12 and more
    characters. clear: no base span overlaps. k is a hash of the text, so that repeated
    ids keep apart. One scan; a text without a find gives no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def finds(kind: int, pattern: str) -> Column:
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
        return F.struct(F.lit(kind).alias("kind"), F.when(text.rlike(pattern), zipped).alias("found"))

    kinds = F.array(*[finds(i, p) for i, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))])
    rows = documents.select("doc_id", F.xxhash64("text").alias("k"), F.explode(kinds).alias("one")).where("one.found is not null")
    rows = rows.select("doc_id", "k", "one.kind", F.posexplode("one.found").alias("at", "f")).where("f.hit is not null")
    rows = rows.select("doc_id", "k", "kind", "at", F.char_length("f.gap").alias("gap"), F.col("f.hit").alias("hit")).distinct()
    each = Window.partitionBy("doc_id", "k", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.char_length("hit")).over(each).cast("int"))
    rows = rows.withColumn("start", F.col("stop") - F.char_length("hit")).drop("gap")
    value = F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 1)).otherwise(F.col("hit"))
    rows = rows.withColumn("value", value)
    least = F.element_at(F.array(F.lit(12), F.lit(18), F.lit(16), F.lit(12)), F.col("kind") + 1)
    rows = rows.where(F.char_length("value") >= least)
    by_start = Window.partitionBy("doc_id", "k").orderBy("start", "kind")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("stop"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("stop")) >= F.col("stop"))
    return rows.withColumn("clear", clear).where("kind < 3 or clear")


def _letter(at: Column) -> Column:
    """The number of the letter at a place of `value`, 0 outside of it."""
    inside = (at >= 1) & (at <= F.char_length("value"))
    return F.when(inside, F.instr(F.lit(ALPHABET), F.substring(F.col("value"), at, F.lit(1)))).otherwise(0)


def train(found: DataFrame) -> list[float]:
    """Log ratio of each pair of letters: random strings against ordinary identifiers.

    Labelled samples: values that the fixed patterns found and `GENERATED` base-64
    digests are random; other strings of 12 and more characters in the form of `ORDINARY`
    are ordinary; the rest has no label. Pair counts cover all labelled strings of all
    documents; the table has SIDE * SIDE numbers whatever the input. A string that occurs
    often counts once for every occurrence. Without ordinary strings nothing is added.
    """
    spark = found.sparkSession
    made = spark.range(GENERATED).select(F.lit(1).alias("label"), F.base64(F.unhex(F.sha2(F.concat(F.lit("random"), "id"), 256))).alias("value"))
    labelled = found.where((F.col("kind") < 3) | F.col("value").rlike(ORDINARY))
    strings = labelled.select(F.when(F.col("kind") < 3, 1).otherwise(0).alias("label"), "value").unionByName(made)
    at = F.explode(F.sequence(F.lit(0), F.char_length("value"))).alias("i")
    pairs = strings.select("label", "value", at).select("label", _letter(F.col("i")).alias("x"), _letter(F.col("i") + 1).alias("y"))
    counts = {(r.label, r.x, r.y): r.n for r in pairs.groupBy("label", "x", "y").agg(F.count("*").alias("n")).collect()}
    ordinary = any(label == 0 for label, _, _ in counts)
    letters = range(SIDE)
    rows = [[sum(counts.get((c, x, y), 0) for y in letters) for x in letters] for c in (0, 1)]
    single = [[(sum(counts.get((c, x, y), 0) for x in letters) + 0.5) / (sum(rows[c]) + 0.5 * SIDE) for y in letters] for c in (0, 1)]
    table = []
    for x in letters:
        for y in letters:  # a pair backs off to how frequent its second letter is
            share = [(counts.get((c, x, y), 0) + PRIOR * single[c][y]) / (rows[c][x] + PRIOR) for c in (0, 1)]
            table.append(round(math.log(share[1] / share[0]), 6) if ordinary else 0.0)
    return table


def ratio(table: list[float]) -> Column:
    """Mean log-likelihood ratio per letter of `value`, whose letters' numbers are in `letters`."""
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length("value") + 1), F.lit(0.0),
        lambda sum_, i: sum_ + F.get(held, F.get("letters", i - 1) * SIDE + F.get("letters", i)),
    )
    return total / (F.char_length("value") + 1)


def found_secrets(documents: DataFrame, margin: float = MARGIN, least: int = LEAST) -> DataFrame:
    """(doc_id, k, kind, start, stop): base spans and those the models add.

    A string of at least `least` characters that no base span overlaps is added when
    its mean log ratio is over `margin`.
    """
    found = cut(spans(documents), "spans")
    table = train(found)
    letters = F.transform(F.sequence(F.lit(0), F.char_length("value") + 1), _letter)
    more = found.where((F.col("kind") == 3) & (F.char_length("value") >= least)).withColumn("letters", letters)
    more = more.where(ratio(table) > margin)
    return found.where("kind < 3").unionByName(more.drop("letters")).select("doc_id", "k", "kind", "start", "stop")


def secret_scan(documents: DataFrame) -> DataFrame:
    """Per row of documents (doc_id, text): counts of base spans, their digest, and all spans.

    Null and empty texts have no span. Null ids and repeated rows each get their answer,
    spans of one row never mix with those of another text. Other columns are not read.
    """
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1)
    written = F.concat_ws(":", name, F.col("s.start").cast("string"), F.col("s.stop").cast("string"))
    rows = found_secrets(documents).select("doc_id", "k", F.struct("start", "kind", "stop").alias("s")).withColumn("said", written)
    count = lambda i: F.count_if(F.col("s.kind") == i)
    listed = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(which)), lambda e: e["said"]), ",")
    each = F.struct("s.start", "s.kind", "s.stop", "said")
    per = rows.groupBy("doc_id", "k").agg(
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)],
        listed(F.when(F.col("s.kind") < 3, each)).alias("base"), listed(each).alias("spans"),
    )
    per = per.withColumnsRenamed({"doc_id": "i", "k": "ik"})
    docs = documents.select("doc_id", F.xxhash64("text").alias("k"))
    docs = docs.join(per, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("ik")), "left")
    return docs.select(
        "doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).cast("bigint").alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each run of overlapping spans replaced by `mark`.

    All rows and columns come back; n_chars, where there is one, counts the new text.
    """
    found = found_secrets(documents.select(F.xxhash64("text").alias("doc_id"), "text"))
    order = Window.partitionBy("k").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.select("k", "start", "stop").distinct().withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("k", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    per = runs.groupBy(F.col("k").alias("k_")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs_"))
    text, runs_ = F.col("row_.text"), F.col("runs_")
    last = lambda i: F.coalesce(F.get(runs_, i - 1)["stop"], F.lit(0))
    pieces = F.transform(runs_, lambda r, i: F.concat(F.substring(text, last(i) + 1, r["start"] - last(i)), F.lit(mark)))
    rest = F.substring(text, last(F.size(runs_)) + 1, F.char_length(text))
    # The caller's columns are fields of one, so that none can clash with those of the search.
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row_"), F.xxhash64("text").alias("k_")).join(per, "k_", "left")
    new = F.when(runs_.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    out = {c: F.col(f"row_.`{c}`") for c in documents.columns} | {"text": new}
    if "n_chars" in documents.columns:
        out["n_chars"] = F.when(runs_.isNull(), out["n_chars"]).otherwise(F.char_length(new)).cast(documents.schema["n_chars"].dataType)
    return docs.select(*[c.alias(name) for name, c in out.items()])
