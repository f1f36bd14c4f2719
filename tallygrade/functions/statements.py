"""Flat SELECT statements taken apart with string functions.

A statement is flat when it is one SELECT without CTE, subquery, set operation
or window. Literals, then brackets from the inside out, then CASE blocks are
replaced by marks, so that clauses, list items and AND-ed predicates can be
found by pattern at the outer level. A statement that is not flat is reported
as such; nothing is guessed about it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.functions.cells import strip

# A lookahead for the first character keeps a pattern from trying all its branches at every place.
LITERAL_OR_COMMENT = r"(?s)(?=['/-])(?:'(?:[^']++|'')*+'|--[^\n]*+|/\*.*?\*/)"
BRACKET = r"\([^()]*+\)"
CASE = r"\bcase\b(?:(?!\bcase\b|\bend\b).)*+\bend\b"
MARK = r"‹[a-z]\d+›"
LEVELS = "abcdef"
BETWEEN_AND = "\x01"

NOT_FLAT = (
    r"(?=[cdefgilmopqrtuvw\"`\[\];])(?:\b(union|intersect|except|minus|with|over|window|lateral|unnest|values|pivot|qualify"
    r"|fetch|within|tablesample|into|top|distinct on|grouping|rollup|cube)\b|[\"`\[\];])"
)
# Clauses after the select list, in the order they must come.
KEYWORDS = ("from", "where", "group by", "having", "order by", "limit", "offset")
CLAUSE_START = r"\s(?=(?:" + "|".join(KEYWORDS) + r")\s)"
JOINER = r",\s*|\s(?:(?:natural|left|right|full|inner|cross|outer|anti|semi)\s)*join\s"
SOURCE = (
    r"^([\w$]+(?:\.[\w$-]+)*)(?:\s(?:as\s)?(?!on\b|using\b)(\w+))?(?:\son\s(.+)|\susing\s.+)?$"
)
# Words that can stand before a bracket without being a function.
BEFORE_BRACKET = (
    "in|and|or|not|on|where|when|then|else|case|between|as|by|having|select|distinct|like|ilike"
    "|using|join|from|exists|any|all|limit|is|end"
)
# Words in an expression that name no column.
WORDS = (
    "and|or|not|in|is|null|like|ilike|between|case|when|then|else|end|as|asc|desc|distinct|true|false"
    "|interval|nulls|first|last|escape|exists|any|all|some|by|from|for|on|using|cast|at|time|zone"
    "|current_date|current_timestamp|current_time|int|integer|bigint|smallint|double|precision|real|float"
    "|decimal|numeric|varchar|char|text|date|timestamp|boolean|year|quarter|month|week|day|hour"
    "|minute|second"
)


def normalise_sql(sql: Column) -> Column:
    """Lower case, comments out, white space to one space, trailing `;` off."""
    text = F.regexp_replace(F.lower(sql), r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, r"--[^\n]*", " ")
    text = strip(F.regexp_replace(text, r"\s+", " "))
    return strip(F.regexp_replace(text, ";+$", ""))


def _swap(text: Column, pattern: str, value, pieces: Column | None = None) -> Column:
    """text with each match of pattern replaced by value(match, index). pieces: the matches, where they are known."""
    if pieces is None:
        pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(pieces, value)
    parts = F.zip_with(
        F.split(text, pattern), found, lambda t, v: F.concat(t, F.coalesce(v, F.lit("")))
    )
    return F.array_join(parts, "")


def _mark(letter: str, i: Column) -> Column:
    return F.concat(F.lit(f"‹{letter}"), i.cast("string"), F.lit("›"))


def _marked(df: DataFrame, text: str, pattern: str, sign: str, letter: str, out: str) -> DataFrame:
    """Replace column text by the text with marks; out: MAP mark -> what it stands for.

    Matches are found once, and only in texts that hold `sign`, which is in every match.
    """
    held = F.col(text).contains(sign)
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumn("_found", F.when(held, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some, marks = F.size("_found") > 0, F.transform("_found", lambda _, i: _mark(letter, i))
    swapped = _swap(F.col(text), pattern, lambda _, i: _mark(letter, i), F.col("_found"))
    return df.withColumns({
        out: F.when(some, F.map_from_arrays(marks, F.col("_found"))).otherwise(F.expr("cast(map() as map<string,string>)")),
        text: F.when(some, swapped).otherwise(F.col(text)),
    }).drop("_found")


def tidy(text: Column) -> Column:
    """One way to write operators, commas and brackets."""
    rules = (
        (r"!=", "<>"),
        (r"==", "="),
        (r"\s*+(?=[<>=|])(<=|>=|<>|\|\||=|<(?![>=])|(?<![<])>(?!=))\s*+", " $1 "),
        (r"\s*([+/%])\s*", " $1 "),
        (r"(?=[\s*-])(?<=[\w›)])\s?([*-])\s?(?=[\w‹(])", " $1 "),
        (r"\s*,\s*", ", "),
        (r"\(\s+", "("),
        (r"\s+\)", ")"),
        (rf"(?=[a-z_])\b(?=\w++ \()(?!(?:{BEFORE_BRACKET})\b)(\w++) \(", "$1("),
        (r"\s+", " "),
    )
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def _unmark(text: Column, pieces: Column, depth: Column) -> Column:
    """Marks put back, outer ones first."""
    return F.aggregate(
        F.sequence(F.lit(1), depth),
        text,
        lambda acc, _: F.when(
            acc.contains("‹"), _swap(acc, MARK, lambda m, i: F.coalesce(F.try_element_at(pieces, m), m))
        ).otherwise(acc),
    )


def _conjuncts(text: Column) -> Column:
    """AND-ed predicates of the outer level; an OR keeps the predicate whole."""
    guarded = F.regexp_replace(text, r"\bbetween (.+?) and ", f"between $1{BETWEEN_AND}")
    split = F.transform(
        F.split(guarded, r"\sand\s"), lambda p: F.replace(p, F.lit(BETWEEN_AND), F.lit(" and "))
    )
    return F.when(text.rlike(r"\bor\b"), F.array(text)).otherwise(split)


def _opened(token: Column, pieces: Column) -> Column:
    """A token that is one bracket, opened and split again."""
    inner = F.try_element_at(pieces, token)
    body = F.regexp_replace(inner, r"^\(|\)$", "")
    return F.when(
        token.rlike(r"^‹[a-f]\d+›$") & inner.isNotNull(), _conjuncts(body)
    ).otherwise(F.array(token))


def predicates(text: Column, pieces: Column) -> Column:
    once = _conjuncts(text)
    for _ in range(2):
        once = F.flatten(F.transform(once, lambda t: _opened(t, pieces)))
    return F.when(F.coalesce(text, F.lit("")) != "", once).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def take_apart(df: DataFrame, sql: str, out: str) -> DataFrame:
    """Add `out`, a struct of the statement's parts; `out.flat` says if it could be taken apart."""
    t, lits, maps = "_text", "_literals", [f"_{c}" for c in LEVELS]
    df = df.withColumn("_raw", F.lower(F.coalesce(F.col(sql), F.lit(""))))
    df = df.withColumn("_found", F.regexp_extract_all("_raw", F.lit(LITERAL_OR_COMMENT), F.lit(0)))
    pieces = F.col("_found")
    df = df.withColumns(
        {
            lits: F.map_from_arrays(F.transform(pieces, lambda _, i: _mark("l", i)), pieces),
            t: _swap(
                F.col("_raw"), LITERAL_OR_COMMENT,
                lambda p, i: F.when(p.startswith("'"), _mark("l", i)).otherwise(" "), pieces,
            ),
        }
    )
    plain = F.regexp_replace(F.regexp_replace(t, r"[\"`]([a-z_]\w*)[\"`]", "$1"), r"\s+", " ")
    df = df.withColumn(t, tidy(F.regexp_replace(strip(plain), r"[; ]+$", "")))
    df = df.withColumn("_whole", F.col(t))
    for level, name in zip(LEVELS, maps):
        df = _marked(df, t, BRACKET, "(", level, name)
    df = _marked(df, t, CASE, "case", "k", "_k")
    df = df.withColumn("_pieces", F.map_concat(*maps, "_k"))
    depth = sum((F.when(F.size(m) > 0, 1).otherwise(0) for m in maps), F.lit(1))

    df = df.withColumn("_parts", F.split(t, CLAUSE_START))

    def part(keyword: str) -> Column:
        found = F.get(F.filter("_parts", lambda p: p.startswith(keyword + " ")), 0)
        return F.coalesce(F.substring(found, len(keyword) + 2, 1 << 30), F.lit(""))

    rank = F.lit(None).cast("int")
    ranks = F.transform(
        F.slice("_parts", 2, 1 << 20),
        lambda p: F.coalesce(*[F.when(p.startswith(k + " "), i) for i, k in enumerate(KEYWORDS)], rank),
    )
    head = F.regexp_replace(part("select"), r"^all\s", "")
    df = df.withColumns(
        {
            "_depth": depth,
            "_distinct": head.startswith("distinct "),
            "_select": F.regexp_replace(head, r"^distinct\s", ""),
            "_from": part("from"), "_where": part("where"), "_group": part("group by"),
            "_having": part("having"), "_order": part("order by"), "_limit": part("limit"),
            "_in_order": F.array_sort(F.array_distinct(ranks)) == ranks,
        }
    )
    sources = F.transform(
        F.when(F.col("_from") != "", F.split("_from", JOINER)).otherwise(
            F.expr("cast(array() as array<string>)")
        ),
        lambda s: F.struct(
            s.rlike(SOURCE).alias("ok"),
            F.regexp_extract(s, SOURCE, 1).alias("full"),
            F.substring_index(F.regexp_extract(s, SOURCE, 1), ".", -1).alias("name"),
            F.regexp_extract(s, SOURCE, 2).alias("alias"),
            F.regexp_extract(s, SOURCE, 3).alias("on"),
        ),
    )
    items = F.transform(
        F.transform(F.split("_select", r",\s"), lambda s: F.struct(s.alias("s"), _aliased(s).alias("named"))),
        lambda x: F.struct(
            F.when(x["named"], F.regexp_extract(x["s"], r"^(.*?)\s(?:as\s)?(\w+)$", 1)).otherwise(x["s"]).alias("expr"),
            F.when(x["named"], F.regexp_extract(x["s"], r"^(.*?)\s(?:as\s)?(\w+)$", 2)).otherwise("").alias("alias"),
        ),
    )
    df = df.withColumns(
        {
            "_sources": sources,
            "_items": items,
            "_joiners": F.regexp_extract_all("_from", F.lit(JOINER), F.lit(0)),
        }
    )
    flat = (
        F.col(t).startswith("select ")
        & F.col("_in_order")
        & ~F.col("_limit").contains(" ")
        & ~F.col("_whole").rlike(NOT_FLAT)
        & (F.size(F.regexp_extract_all("_whole", F.lit(r"\bselect\b"), F.lit(0))) == 1)
        & ~F.col(t).rlike(r"[()]|\bcase\b")
        & F.forall("_sources", lambda s: s["ok"])
    )
    keep = [
        F.coalesce(flat, F.lit(False)).alias("flat"),
        F.col("_distinct").alias("distinct"),
        F.col("_items").alias("items"), F.col("_sources").alias("sources"),
        F.col("_joiners").alias("joiners"), F.col("_where").alias("where"),
        F.col("_group").alias("group"), F.col("_having").alias("having"),
        F.col("_order").alias("order"), F.col("_limit").alias("limit"),
        F.col("_pieces").alias("pieces"), F.col(lits).alias("literals"), F.col("_depth").alias("depth"),
    ]
    drop = ["_raw", t, lits, *maps, "_k", "_found", "_whole", "_pieces", "_depth", "_distinct", "_select", "_parts", "_in_order",
            "_from", "_where", "_group", "_having", "_order", "_limit", "_sources", "_items", "_joiners"]
    return df.withColumn(out, F.struct(*keep)).drop(*drop)


def _aliased(item: Column) -> Column:
    """Does a select item end in an output name, with or without AS?"""
    explicit = item.rlike(r"\sas\s\w+$")
    implicit = item.rlike(r"^.*[\w›*]\s[a-z_]\w*$") & ~item.rlike(
        r"(^|\s)(is|and|or|not|like|in|between|by|interval|distinct|[-+*/%|=<>]+)\s\w+$"
        r"|\s(null|true|false|end|asc|desc)$"
    )
    return explicit | implicit


def _named(text: Column, s: Column, literals: bool = True) -> Column:
    """Marks put back, qualifiers of aliases turned into table names, schema prefixes off."""
    open_text = _unmark(text, s["pieces"], s["depth"])
    named = F.aggregate(
        s["sources"],
        open_text,
        lambda acc, x: F.when(
            (x["alias"] != "") & acc.contains(F.concat(x["alias"], F.lit("."))),
            F.regexp_replace(
                acc,
                F.concat(F.lit(r"(?<![\w.])"), F.when(x["alias"] != "", x["alias"]).otherwise("-"), F.lit(r"\.")),
                F.concat(x["name"], F.lit(".")),
            ),
        ).otherwise(acc),
    )
    short = F.regexp_replace(named, r"(?=[a-z_])(?<![\w.])(?:[a-z_]\w*\.)+([a-z_]\w*\.(?:\w+|\*))", "$1")
    return _unmark(short, s["literals"], F.lit(1)) if literals else short


COMPARISON = r"^([^=<>]+) (=|<>) ([^=<>]+)$"


def _token(text: Column, s: Column) -> Column:
    """A predicate or expression in its normal form; `a = b` has its sides in one order."""
    symmetric = text.rlike(COMPARISON) & ~text.rlike(r"\b(and|or|not|between|in|is|like|ilike)\b")
    sides = F.when(
        symmetric, F.array(F.regexp_extract(text, COMPARISON, 1), F.regexp_extract(text, COMPARISON, 3))
    ).otherwise(F.array(text))
    named = F.array_sort(F.transform(sides, lambda x: _named(x, s)))
    op = F.concat(F.lit(" "), F.regexp_extract(text, COMPARISON, 2), F.lit(" "))
    return F.aggregate(named, F.lit(None).cast("string"),
                       lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, op, x)))


def _list(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.split(text, r",\s")).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def _output(item: Column, s: Column, ordinals: bool = True) -> Column:
    """GROUP BY 1 or ORDER BY total: the select expression they mean."""
    by_alias = F.get(F.filter(s["items"], lambda x: (x["alias"] != "") & (x["alias"] == item)), 0)["expr"]
    by_number = F.when(item.rlike(r"^\d+$"), F.get(s["items"], item.try_cast("int") - 1)["expr"])
    return F.coalesce(by_number, by_alias, item) if ordinals else F.coalesce(by_alias, item)


ORDER_ITEM = r"^(.+?)(?: (asc|desc))?(?: nulls (?:first|last))?$"


def clause_tokens(s: Column) -> Column:
    """ARRAY of (clause, token) of a flat statement; empty for any other."""

    def tag(clause: str, raw: Column) -> Column:
        return F.transform(
            raw,
            lambda t: F.struct(F.lit(clause).alias("clause"), t.alias("raw"), F.lit("").alias("tail")),
        )

    outputs = lambda items: F.transform(items, lambda g: _output(g, s))
    joined = F.flatten(F.transform(s["sources"], lambda x: predicates(x["on"], s["pieces"])))
    order = F.transform(
        _list(s["order"]),
        lambda o: F.struct(
            F.lit("order").alias("clause"),
            _output(F.regexp_extract(o, ORDER_ITEM, 1), s).alias("raw"),
            F.when(F.regexp_extract(o, ORDER_ITEM, 2) == "desc", " desc").otherwise(" asc").alias("tail"),
        ),
    )
    raw = F.concat(
        tag("select", s["items"]["expr"]),
        tag("from", s["sources"]["name"]),
        tag("join", joined),
        tag("where", predicates(s["where"], s["pieces"])),
        tag("group", outputs(_list(s["group"]))),
        tag("having", predicates(s["having"], s["pieces"])),
        order,
        tag("limit", _list(s["limit"])),
    )
    tokens = F.transform(
        raw,
        lambda x: F.struct(
            x["clause"].alias("clause"), F.concat(_token(x["raw"], s), x["tail"]).alias("token")
        ),
    )
    return F.when(s["flat"], tokens).otherwise(
        F.expr("cast(array() as array<struct<clause:string,token:string>>)")
    )


def canonical(s: Column) -> Column:
    """A flat statement without output names, table aliases, schema prefixes and NULLS order."""
    name = lambda t: _named(t, s)
    said = lambda word, text: F.when(
        F.coalesce(text, F.lit("")) != "", F.concat(F.lit(word), text)
    ).otherwise("")
    sources = F.transform(
        s["sources"], lambda x: F.concat(x["name"], said(" on ", name(x["on"])))
    )
    read = F.array_join(
        F.zip_with(sources, s["joiners"], lambda x, j: F.concat(x, F.coalesce(j, F.lit("")))), ""
    )
    having = F.aggregate(
        s["items"],
        s["having"],
        lambda acc, x: F.when(
            x["alias"] != "",
            F.regexp_replace(
                acc,
                F.concat(F.lit(r"(?<![\w.])"), F.when(x["alias"] != "", x["alias"]).otherwise("-"), F.lit(r"(?![\w.(])")),
                F.regexp_replace(x["expr"], r"([\\$])", r"\\$1"),
            ),
        ).otherwise(acc),
    )
    order = F.transform(
        _list(s["order"]),
        lambda o: F.concat(
            name(_output(F.regexp_extract(o, ORDER_ITEM, 1), s, False)),
            said(" ", F.regexp_extract(o, ORDER_ITEM, 2)),
        ),
    )
    group = F.transform(_list(s["group"]), lambda g: name(_output(g, s, False)))
    return F.concat(
        F.lit("select "),
        F.when(s["distinct"], "distinct ").otherwise(""),
        F.array_join(F.transform(s["items"]["expr"], name), ", "),
        said(" from ", read),
        said(" where ", name(s["where"])),
        said(" group by ", F.array_join(group, ", ")),
        said(" having ", name(having)),
        said(" order by ", F.array_join(order, ", ")),
        said(" limit ", name(s["limit"])),
    )


def order_keys(s: Column, columns: Column) -> Column:
    """Positions of the ORDER BY keys among the result columns; NULL if any has none.

    A key is a position, the name of exactly one result column, or a select
    expression written the same way.
    """
    names = F.transform(columns, F.lower)
    open_text = lambda x: _unmark(x, s["pieces"], s["depth"])
    exprs = F.transform(s["items"]["expr"], open_text)
    aligned = (F.size(s["items"]) == F.size(columns)) & ~F.exists(
        s["items"], lambda x: x["expr"].rlike(r"(^|\.)\*$")
    )

    def position(o: Column) -> Column:
        key = F.regexp_extract(o, ORDER_ITEM, 1)
        number = F.when(key.rlike(r"^\d+$"), key.try_cast("int") - 1)
        once = F.size(F.filter(names, lambda n: n == key)) == 1
        by_name = F.when(key.rlike(r"^[a-z_]\w*$") & once, F.array_position(names, key).cast("int") - 1)
        spot = F.array_position(exprs, open_text(key)).cast("int")
        by_text = F.when(aligned & (spot > 0), spot - 1)
        found = F.coalesce(number, by_name, by_text)
        return F.when((found >= 0) & (found < F.size(columns)), found)

    keys = F.transform(_list(s["order"]), position)
    whole = s["flat"] & (F.size(keys) > 0) & F.forall(keys, lambda k: k.isNotNull())
    return F.when(whole, keys)


def has_order_by(s: Column) -> Column:
    return s["flat"] & (F.coalesce(s["order"], F.lit("")) != "")


def references(s: Column) -> Column:
    """ARRAY of (qualifier, name): the columns a flat statement names."""
    exprs = F.concat(
        s["items"]["expr"],
        F.transform(s["sources"], lambda x: x["on"]),
        F.array(s["where"], s["group"], s["having"], s["order"]),
    )
    text = _unmark(F.concat_ws(" , ", exprs), s["pieces"], s["depth"])
    bare = F.regexp_replace(F.regexp_replace(text, r"\bas\s\w+", " "), MARK, " ")
    found = F.regexp_extract_all(
        bare, F.lit(r"(?<![\w.:])([a-z_]\w*(?:\.[a-z_]\w*)*)(?![\w.]|\()"), F.lit(1)
    )
    kept = F.filter(F.array_distinct(found), lambda w: ~w.rlike(rf"^(?:{WORDS})$"))
    return F.transform(
        kept,
        lambda w: F.struct(
            F.when(
                w.contains("."),
                F.substring_index(F.regexp_replace(w, r"\.[^.]*$", ""), ".", -1),
            ).otherwise("").alias("qualifier"),
            F.substring_index(w, ".", -1).alias("name"),
        ),
    )
