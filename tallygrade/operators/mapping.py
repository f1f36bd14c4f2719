"""Choice of one generated column per expected column where several would fit.

Most cases have one fitting column each and never come here. The rest are decided on a small graph, whatever
the size of their results: its nodes are columns, its edges say which two expected columns together hold the values of
which two generated ones. Rows are only read by partial aggregates, for the edges and for the test of a choice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.operators.bags import row_counts
from tallygrade.operators.columns import containing_columns, fingerprints
from tallygrade.session import cut

# Choices looked at per case and pass before a search gives up. None: every search runs to its end, so
# that "no mapping" is proven; a caller who sets a number accepts mismatches that are not.
MAX_STEPS: int | None = None
# Most choices tested over the rows in one pass. The first pass tests one, each later one eight times as many.
TRIED = 64


def options_of(classes: Column) -> Column:
    """ARRAY of (col, options): each expected column, fewest options first."""
    per_class = F.transform(
        classes,
        lambda c: F.transform(
            c["e"],
            lambda e: F.struct(
                F.size(c["g"]).alias("n"), e["col"].alias("col"), c["g"].alias("options")
            ),
        ),
    )
    return F.array_sort(F.flatten(per_class))


def _plan(options: DataFrame) -> DataFrame:
    """Columns with one option (fixed), the others in search order, and the pairs of those."""
    one, more = (F.filter("options", lambda o: F.size(o["options"]) == 1), F.filter("options", lambda o: F.size(o["options"]) > 1))
    named = options.select("case_id", "options", one.alias("one"), more.alias("more")).select(
        "case_id",
        "options",
        "more",
        F.col("one.col").alias("fixed_e"),
        F.transform("one", lambda o: o["options"][0]["col"]).alias("fixed_g"),
        F.col("more.col").alias("e_cols"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("more", lambda o: o["options"]["col"])))).alias("g_cols"),
    )
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return named.select(
        "*",
        F.flatten(
            F.transform("e_cols", lambda x, i: F.transform(F.slice("e_cols", i + 1, F.size("e_cols")), lambda y: pair(x, y)))
        ).alias("e_pairs"),
        F.flatten(F.transform("g_cols", lambda x: F.transform("g_cols", lambda y: pair(x, y)))).alias("g_pairs"),
    )


def _cell(j: Column) -> Column:
    """A cell for a hash, which passes over NULLs; no tagged cell is empty."""
    return F.coalesce(F.element_at("vals", j + 1), F.lit(""))


def _of_side(e: str, g: str) -> Column:
    return F.when(F.col("side") == "e", F.col(e)).otherwise(F.col(g))


def _context() -> Column:
    """Hash of a row's cells in the fixed columns, equal on both sides for rows that match."""
    return F.xxhash64(F.transform(_of_side("fixed_e", "fixed_g"), _cell))


def _texts(hashes: Column) -> Column:
    return F.transform(hashes, lambda h: h.cast("string"))


def _agreements(virtual: DataFrame, subset: bool) -> DataFrame:
    """(case_id, e, g): for made-up columns, what tells if a generated one may stand for an expected one.

    Bags: a number per column of each side, equal if the columns hold the same values as often. Subsets: e is
    empty, and g lists for each generated column the expected ones that hold all its values.
    """
    if subset:
        held = containing_columns(virtual.select("case_id", "side", "vals").distinct())
        entry = F.struct(F.col("generated_col").alias("col"), "expected_cols")
        lists = held.groupBy("case_id").agg(F.array_sort(F.collect_list(entry)).alias("g"))
        return lists.select("case_id", F.lit(None).cast("array<bigint>").alias("e"), F.col("g.expected_cols").alias("g"))
    prints = fingerprints(virtual, bucket=True)
    entry = F.struct("col", F.xxhash64("values").alias("h"))
    lists = prints.groupBy("case_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, entry))).alias(s) for s in "eg"]
    )
    return lists.select("case_id", F.col("e.h").alias("e"), F.transform("g", lambda x: F.array(x["h"])).alias("g"))


def column_graph(rows: DataFrame, options: DataFrame, subset: bool) -> DataFrame:
    """One row per case: its plan, and e, g of `_agreements` for all pairs of columns that are not fixed.

    A pair stands beside the fixed cells of its row, so that one key column settles most pairs. As long as a
    case's columns squared, never as long as its rows.
    """
    plan = cut(_plan(options), "plan")
    hashed = F.transform(_of_side("e_pairs", "g_pairs"), lambda p: F.xxhash64("context", _cell(p["x"]), _cell(p["y"])))
    virtual = rows.join(plan.drop("options", "more"), "case_id").withColumn("context", _context())
    virtual = virtual.select("case_id", "side", "bucket", _texts(hashed).alias("vals"))
    return cut(plan.join(_agreements(virtual, subset), "case_id", "left").drop("e_pairs", "g_pairs"), "columns")


def choices_of(more, fixed_g, e, g, g_cols, last, bad, most: int, max_steps: int | None) -> list[list[int]]:
    """The next `most` choices that all pairs of columns allow, in search order.

    more: the open columns with their options; last, bad: a choice whose first `bad` columns are wrong, the
    next ones are behind it. Pairs prune the options until they agree (arc consistency), a matching by
    augmenting paths shows that every column can have one of its own, then choices are made column by column.
    """
    import numpy as np

    n, at = len(more), {j: i for i, j in enumerate(g_cols)}
    if len(set(fixed_g)) < len(fixed_g) or bad == 0:
        return []
    if not n:
        return [] if last is not None else [[]]
    taken = set(fixed_g)
    open_ = np.zeros((n, len(g_cols)), bool)
    for p, o in enumerate(more):
        open_[p, [at[x["col"]] for x in o["options"] if x["col"] not in taken]] = True
    width, pairs, k = len(g_cols), {}, 0
    table = None if e is None else np.array([x[0] for x in g], np.int64).reshape(width, width)
    for p in range(n):
        for q in range(p, n):
            if e is None:
                ok = np.fromiter((k in held for held in g), bool, len(g)).reshape(width, width)
            else:
                ok = table == e[k]
            k += 1
            if p == q:
                open_[p] &= ok.diagonal()
            else:
                ok = ok & ~np.eye(width, dtype=bool)
                pairs[p, q], pairs[q, p] = ok, ok.T
    before = -1
    while before != open_.sum():
        before = open_.sum()
        for (p, q), ok in pairs.items():
            open_[p] &= ok[:, open_[q]].any(axis=1)

    owner: dict[int, int] = {}

    def placed(p: int, seen: set[int]) -> bool:
        """Give p a column of its own, moving others along an augmenting path."""
        for j in np.flatnonzero(open_[p]).tolist():
            if j not in seen:
                seen.add(j)
                if j not in owner or placed(owner[j], seen):
                    owner[j] = p
                    return True
        return False

    if not all(placed(p, set()) for p in range(n)):
        return []
    found: list[list[int]] = []
    chosen: list[int] = []
    steps = 0

    def free_twin(p: int, j: int) -> bool:
        """Is there an unused column before j with the same data?"""
        look = next(x["identity"] for x in more[p]["options"] if x["col"] == j)
        return any(x["col"] < j and x["identity"] == look and x["col"] not in chosen and x["col"] not in taken for x in more[p]["options"])

    # One entry per chosen column: what is still open behind it, the options left to try, and if all before equals `last`.
    def entry(left, p: int, tight: bool):
        options = np.flatnonzero(left[p]).tolist()
        if tight and p < bad:
            least = at[last[p]] + (p == bad - 1)
            options = [j for j in options if j >= least]
        return left, iter(options), tight and p < bad - 1

    stack = [entry(open_, 0, last is not None)]
    while stack and len(found) < most and (max_steps is None or steps < max_steps):
        left, options, tight = stack[-1]
        p = len(stack) - 1
        j = next(options, None)
        if j is None:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        if free_twin(p, g_cols[j]):
            continue
        steps += 1
        behind = left.copy()
        for q in range(p + 1, n):
            behind[q] &= pairs[p, q][j]
        behind[p + 1 :, j] = False
        if not behind[p + 1 :].any(axis=1).all():
            continue
        chosen.append(g_cols[j])
        if len(chosen) == n:
            found.append(list(chosen))
            chosen.pop()
        else:
            stack.append(entry(behind, p + 1, tight and g_cols[j] == last[p]))
    return found


def proposals(graph: DataFrame, most: int) -> DataFrame:
    """(case_id, choices): the next choices of each case; graph also has last ARRAY<INT> and bad INT."""
    import pyarrow as pa

    kind, max_steps = graph.schema["case_id"].dataType.simpleString(), MAX_STEPS
    names = ["more", "fixed_g", "e", "g", "g_cols", "last", "bad"]

    def propose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            made = [choices_of(*case, most, max_steps) for case in zip(*columns)]
            yield pa.record_batch([batch.column("case_id"), pa.array(made, pa.list_(pa.list_(pa.int32())))], ["case_id", "choices"])

    return graph.select("case_id", *names).mapInArrow(propose, f"case_id {kind}, choices array<array<int>>")


def _tested(rows: DataFrame, graph: DataFrame, subset: bool) -> DataFrame:
    """(case_id, fails): per choice the least number of open columns that already differ; null where all agree.

    One pass for all choices: each row becomes a hash per choice and number of columns, so that a wrong choice
    also tells how many of the next ones are wrong for the same reason.
    """
    prefixes = lambda cols: F.aggregate(
        cols,
        F.array(F.col("context")),
        lambda done, j: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), _cell(j)))),
    )
    asked = graph.select("case_id", "fixed_e", "fixed_g", "e_cols", "choices")
    virtual = rows.join(asked, "case_id").withColumn("context", _context())
    hashes = F.when(F.col("side") == "e", prefixes(F.col("e_cols"))).otherwise(F.flatten(F.transform("choices", prefixes)))
    found = _agreements(virtual.select("case_id", "side", "bucket", _texts(hashes).alias("vals")), subset)
    width = F.size("e_cols") + 1
    right = (lambda k, h: F.array_contains(h, k)) if subset else (lambda k, h: h[0] == F.get(F.col("e"), k))
    joined = graph.select("case_id", "e_cols", "choices").join(found, "case_id", "left")
    first_wrong = lambda r: F.get(
        F.filter(F.sequence(F.lit(0), F.size("e_cols")), lambda k: ~F.coalesce(right(k, F.get(F.col("g"), r * width + k)), F.lit(False))), F.lit(0)
    )
    return joined.select("case_id", F.transform("choices", lambda c, r: first_wrong(r)).alias("fails"))


def search(rows: DataFrame, options: DataFrame, subset: bool = False) -> DataFrame:
    """(case_id, mapping) for every case of `options` (case_id, options); mapping is null where there is none.

    rows: case_id, side, bucket, vals. The first choice that the column graph allows is nearly always right; it is tested
    on the values. Cases whose choice is wrong go on with more choices a pass, behind the columns that were found to
    differ, until a choice is right or none is left. Ties go to the first in search order. For subsets a pair of
    columns says little where all pairs of few values occur: many such columns can take many passes.
    """
    kept = rows.join(options.select("case_id"), "case_id", "left_semi").select("case_id", "side", "bucket", "vals")
    graph = column_graph(kept, options, subset)
    none = F.lit(None)
    state = graph.select("case_id", none.cast("array<int>").alias("last"), none.cast("int").alias("bad"))
    settled: list[DataFrame] = []
    most = 1
    while True:
        known = graph.join(state, "case_id")
        known = cut(known.drop("last", "bad").join(proposals(known, most), "case_id"), "choices")
        over = known.where(F.size("choices") == 0)
        live = known.where(F.size("choices") > 0)
        tested = _tested(kept.join(live.select("case_id"), "case_id", "left_semi"), live, subset)
        tested = live.select("case_id", "fixed_e", "fixed_g", "e_cols", "choices").join(tested, "case_id")
        hit = F.array_position(F.transform("fails", lambda f: f.isNull()), True).cast("int")
        tested = tested.withColumn("hit", F.when(hit > 0, hit))
        picked = F.concat(F.arrays_zip(F.col("fixed_e").alias("e"), F.col("fixed_g").alias("g")), F.arrays_zip(F.col("e_cols").alias("e"), F.element_at("choices", F.col("hit")).alias("g")))
        tested = cut(tested.withColumn("mapping", F.when(F.col("hit").isNotNull(), F.transform(F.array_sort(picked), lambda x: x["g"]))), "tested")
        right = agreement(kept, tested.where("mapping IS NOT NULL").select("case_id", "mapping"), bucket=True, subset=subset)
        tested = cut(tested.join(right, "case_id", "left"), "agreed")
        settled.append(tested.where("agrees").select("case_id", "mapping"))
        settled.append(over.select("case_id", none.cast("array<int>").alias("mapping")))
        # equal hashes of different values: the whole choice is wrong, the next one is behind it
        last = F.coalesce("hit", F.size("choices"))
        state = tested.where("NOT coalesce(agrees, false)").select(
            "case_id", F.element_at("choices", last).alias("last"), F.coalesce(F.element_at("fails", last), F.size("e_cols")).alias("bad")
        )
        if state.isEmpty():
            break
        most = min(8 * most, TRIED)
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result


def projected(rows: DataFrame, mappings: DataFrame, bucket: bool = False) -> DataFrame:
    """Rows with `proj`: expected rows as they are, generated rows by their mapping."""
    keep = ["case_id", "side"] + (["bucket"] if bucket else [])
    proj = F.when(F.col("side") == "e", F.col("vals")).otherwise(
        F.transform("mapping", lambda j: F.element_at("vals", j + 1))
    )
    return rows.join(mappings.select("case_id", "mapping"), "case_id").select(
        *keep, proj.alias("proj")
    )


def agreement(rows: DataFrame, mappings: DataFrame, bucket: bool, subset: bool = False) -> DataFrame:
    """(case_id, agrees): do the rows agree under the case's mapping?"""
    place = ["bucket"] if bucket else []
    counts = row_counts(projected(rows, mappings, bucket), [*place, "proj"])
    if subset:
        ok = (F.col("in_generated") == 0) | (F.col("in_expected") > 0)
    else:
        ok = F.col("in_expected") == F.col("in_generated")
    return counts.groupBy("case_id").agg(F.bool_and(ok).alias("agrees"))
