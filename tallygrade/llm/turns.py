"""Repair of conversations: the cheapest edits that make roles take turns.

Each row becomes a letter for its role and fault. A conversation's letters are collapsed to runs; a run advances the
costs of the four states of the wanted order by cached binary powers of its min-plus transition, and the choices
are then unrolled from the front, the least letter first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.session import cut

# What edits cost, and white space.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Rows whose letters are put together in one step.
CHUNK = 1 << 16

# States: nothing yet, after a system row, after a user row, after an assistant row.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NEVER = 1 << 40


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that crc32(`conv_id:turn`) % 20 names.

    0 drops the row, 1 empties its text, 2 takes `[.!?]` out, 3 repeats it, 4 makes it a user's. Null roles and texts become one
    space, as null ids and turns do in the key.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _order() -> list[Column]:
    """Rows of a conversation: by turn, nulls first; ties by role, then by the text's md5."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("mark").asc_nulls_first()]


def letters(rows: DataFrame) -> DataFrame:
    """(conv_id, letters): one letter per row in order, for its role's initial (s, u, a or other) and its first fault.

    Rows are dealt by ranges of (conv_id, turn, role, text), so that a conversation with a third of all rows is spread; only
    marks of texts are shuffled. A repeated row is found by the least place of its (role, text): places are unique, so neither
    join side has a hot key. Letters meet in steps of CHUNK rows; a conversation's letters are as long as the audit that it returns.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("mark"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("short")
    )
    placed = slim.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed.drop("turn"), "turns")
    firsts = placed.groupBy("conv_id", "role", "mark").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("short"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marked = placed.join(firsts, "place", "left").select("conv_id", "place", F.char(F.lit(97) + 4 * role + fault).alias("letter"))
    put = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["letter"]), "")
    chunks = marked.groupBy("conv_id", F.floor(F.col("place") / CHUNK).alias("at")).agg(put(F.struct("place", "letter")).alias("letter"))
    return chunks.groupBy("conv_id").agg(put(F.struct("at", "letter")).alias("letters"))


def _of(letter: str) -> tuple[int, int]:
    """Role and fault of a letter."""
    return divmod(ord(letter) - 97, 4)


def moves(letter: str) -> list[tuple[str, int, int, int]]:
    """What may be done with a row of this letter: (edit, state before, state after, cost)."""
    role, fault = _of(letter)
    found = [("D", s, s, DELETE) for s in range(4)]
    if fault in (0, 3):
        more = TRUNCATED if fault else 0
        if role == 0:
            found.append(("K", BEGIN, SYSTEM, more))
        found += [("K", s, t, more) for s, t in NEXT.items() if t == {1: USER, 2: ASSISTANT}.get(role)]
        found += [("R", s, t, REROLE + more) for s, t in NEXT.items()]
    return found


def product(a, b):
    """Min-plus product: a's rows first, then b's."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


class Repair:
    """The cheapest edits of conversations; transitions, their powers and costs that came before are kept."""

    def __init__(self) -> None:
        step = tuple(tuple(0 if s == t else INSERT if NEXT[s] == t else NEVER for t in range(4)) for s in range(4))
        self.inserts = product(product(step, step), step)
        self.end = tuple(min(0 if s == BEGIN else NEVER, row[ASSISTANT]) for s, row in enumerate(self.inserts))
        self.powers: dict = {}
        self.steps: dict = {}
        self.choices: dict = {}
        self.known: dict = {}

    def power(self, letter: str, k: int):
        """The transition of 2^k rows of one letter, new rows before each of them included."""
        if (letter, k) not in self.powers:
            if k:
                half = self.power(letter, k - 1)
                self.powers[letter, k] = product(half, half)
            else:
                row = [[NEVER] * 4 for _ in range(4)]
                for _, s, t, cost in moves(letter):
                    row[s][t] = min(row[s][t], cost)
                self.powers[letter, k] = product(self.inserts, row)
        return self.powers[letter, k]

    def advance(self, letter: str, count: int, ahead: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        """The costs before `count` rows of a letter where those after them are `ahead`: (least, costs above the least)."""
        step = (letter, count, ahead)
        if step not in self.steps:
            k = 0
            while count:
                if count & 1:
                    ahead = tuple(min(c + x for c, x in zip(row, ahead)) for row in self.power(letter, k))
                count >>= 1
                k += 1
            least = min(ahead)
            if len(self.steps) > 1 << 16:
                self.steps.clear()
            self.steps[step] = least, tuple(x - least for x in ahead)
        return self.steps[step]

    def choice(self, letter: str, state: int, least: int, here: tuple[int, ...], after: tuple[int, ...]) -> tuple[str, int]:
        """The least edit that keeps the cost in front of a row, and the state that it leads to."""
        asked = (letter, state, least, here, after)
        if asked not in self.choices:
            fits = [(e, t) for e, s, t, cost in moves(letter) if s == state and cost + after[t] == here[state] + least]
            if here[NEXT[state]] + INSERT == here[state]:
                fits.append(("I", NEXT[state]))
            if len(self.choices) > 1 << 16:
                self.choices.clear()
            self.choices[asked] = min(fits)
        return self.choices[asked]

    def edits(self, text: str) -> tuple[int, str]:
        """(cost, audit): the least cost of the edits of a conversation's letters, and of the cheapest ones the ASCII-least.

        Costs are kept once per run, relative to their least: few different ones occur. Each edit leads to one
        state, so the least one that keeps the cost is the right one in front of every row.
        """
        runs = [(letter, sum(1 for _ in same)) for letter, same in groupby(text)]
        behind, total = [self.end], 0
        for letter, count in reversed(runs):
            least, ahead = self.advance(letter, count, behind[-1])
            total += least
            behind.append(ahead)
        behind.reverse()
        total += behind[0][BEGIN]
        state, audit = BEGIN, []
        for (letter, count), after_run in zip(runs, behind[1:]):
            left = count
            while left:  # a run's inner costs are made in stretches, so that they are never all held
                size = min(CHUNK, left)
                left -= size
                inner = [self.advance(letter, left, after_run)]
                for _ in range(size):
                    inner.append(self.advance(letter, 1, inner[-1][1]))
                for j in range(size, 0, -1):
                    least, here = inner[j]
                    edit = "I"
                    while edit == "I":
                        edit, state = self.choice(letter, state, least, here, inner[j - 1][1])
                        audit.append(edit)
        while self.end[state]:
            audit.append("I")
            state = NEXT[state]
        return total, "".join(audit)

    def facts(self, text: str) -> tuple[int, int, int, int, int, str]:
        """(blank, duplicate, truncated, illegal, cost, audit) of a conversation's letters."""
        if text in self.known:
            return self.known[text]
        roles, faults = zip(*map(_of, text))
        illegal = sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:]))
        found = (faults.count(1), faults.count(2), faults.count(3), illegal, *self.edits(text))
        if len(text) < 100 and len(self.known) < 1 << 16:
            self.known[text] = found
        return found


def plans(letters: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of each conversation (conv_id, letters)."""
    kind = letters.schema["conv_id"].dataType.simpleString()
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def planned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair()
        for batch in batches:
            found = list(zip(*[repair.facts(t) for t in batch.column("letters").to_pylist()])) or [()] * 6
            columns = [pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, found)]
            yield pa.record_batch([batch.column("conv_id"), *columns], ["conv_id", *names])

    return letters.select("conv_id", "letters").mapInArrow(planned, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def lines(state: int, audit: str, at: int) -> tuple[list[str], int, int]:
    """New rows in front of a row: their lines, the state and the place in the audit after them."""
    new = []
    while at < len(audit) and audit[at] == "I":
        state = NEXT[state]
        new.append(("user:", "assistant:")[state - USER])
        at += 1
    return new, state, at


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations` with what `rows` (conv_id, turn, role, text) need to take turns.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; the wanted order is `(s?(ua)+)?` of role
    initials. Null conv_ids are one conversation, null turns come first, null roles and texts are empty texts here; rows with the
    same turn go by role, then by the md5 of their text. A conversation without rows has zeros, an empty audit
    and the hash of the empty text; an empty table gives an empty table. Other columns are ignored.

    The hash runs over a conversation's rows one after the other, so they pass through one task in order; it holds one
    batch of rows and the audit.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spans = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = conversations.select("conv_id").distinct()
    parts = [whole, spans, plans(letters(rows))]
    for n in names:  # null-safe join by union: one row per conversation and part
        kind = "string" if n == "audit" else "long"
        parts = [p if n in p.columns else p.withColumn(n, F.lit(None).cast(kind)) for p in parts]
    heads = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("conv_id").agg(*[F.max(n).alias(n) for n in names])
    fill = lambda n: F.coalesce(n, F.lit("") if n == "audit" else F.lit(0).cast("long")).alias(n)
    none = lambda n, kind: F.lit(None).cast(kind).alias(n)
    turn = rows.schema["turn"].dataType
    heads = heads.select("conv_id", *[fill(n) for n in names], F.lit(0).alias("part"), F.lit(None).cast(turn).alias("turn"), none("role", "string"), none("text", "string"), none("mark", "binary"))
    bodies = rows.select(
        "conv_id", *[none(n, "string" if n == "audit" else "long") for n in names], F.lit(1).alias("part"), "turn", "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("mark")
    )
    key, *rest = _order()
    ordered = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(key, F.col("part"), *rest)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, first, state, at = None, hashlib.sha256(), True, BEGIN, 0
        done: list[tuple] = []

        def add(new: list[str]) -> None:
            nonlocal first
            for line in new:
                sha.update((line if first else "\n" + line).encode())
                first = False

        def close() -> None:
            if head is not None:
                add(lines(state, head[-1], at)[0])
                done.append((*head, sha.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], ["conv_id", *names, "repaired_sha256"])
            done.clear()
            return out

        types: list = []
        for batch in batches:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = [batch.column(c).to_pylist() for c in ("conv_id", *names, "part", "role", "text")]
            for *facts_of, part, role, text in zip(*columns):
                if part == 0:
                    close()
                    head, sha, first, state, at = facts_of, hashlib.sha256(), True, BEGIN, 0
                    continue
                audit = head[-1]
                new, state, at = lines(state, audit, at)
                edit = audit[at]
                at += 1
                if edit == "R":
                    state = NEXT[state]
                    new.append(f"{('user', 'assistant')[state - USER]}:{text}")
                elif edit == "K":
                    state = SYSTEM if role[:1] == "s" else NEXT[state]
                    new.append(f"{role}:{text}")
                add(new)
            if done:
                yield batch_of()
        close()
        if done:
            yield batch_of()

    return ordered.select("conv_id", *names, "part", "role", "text").mapInArrow(
        hashed, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
