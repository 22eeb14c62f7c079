"""Repair of conversation structure by a Viterbi search whose survivors share what is settled.

A conversation is its rows by turn (null turns first; ties by role, then text). It is well formed
if it is empty, or an optional system turn and then one or more pairs of a user and an
assistant turn, by the roles' first letters. Edits: keep a row (K, cost 0), give it the user's or the assistant's role
(R, 3), delete it (D, 4), insert an empty user or assistant turn anywhere (I, 3); a
truncated row that stays costs 3 more; blank and duplicate rows must go. Wanted are the
cheapest edits, of several the least string of letters.

Four states (nothing yet, after system, after user, after assistant) have a survivor each: its cost and a
node of a tree of back pointers. Nodes count the nodes and survivors that hang on them and go
when none do; as soon as all survivors share an ancestor, the edits up to it
are settled and leave the tree. Survivors that can't win any more are dropped: "nothing yet" costs at most 4
(a system row) less than "after assistant" from there on, "after system" nothing less. Of two ways into a state with one
cost the letters from where they part decide, all of them; the letters and the rows fix
the cost, so neither is the other's beginning and the order can't change later.

Conversations of up to BLOCK rows are repaired whole, in streams of sorted rows: their texts are
shuffled once. Of longer ones rows of equal turn, role and text are counted before they are sorted (all but
the first are duplicates), and the counted lines are cut into blocks of BLOCK, each searched from all four states in a task of its own;
the same search then runs over a conversation's blocks, and the chosen letters go back to
the blocks. Only that search and the hash of the repaired text, which can't be cut, see a conversation's
blocks one after another.

Defined results: null roles and texts count as one space, null ids as an id of their own; a role that is
empty or starts otherwise than s, u or a cannot be kept; rows of repeat count 0 only
leave their conversation's id (zeros, no edits, the hash of nothing); an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import materialize, running

#: Rows of a conversation (or counted lines of a block of a longer one) that one search sees.
BLOCK = 4096

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STARTS, ENDS = NOTHING, (NOTHING, ASSISTANT)
FAULTS = FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: (state, initial of the turn that comes) -> state
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}

Edges = list[tuple[int, int, int, str]]


def _inserted(edges: Edges) -> Edges:
    """Edges with up to two inserted turns after each; of several between two states the cheapest, then the least."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for a, b, cost, label in edges:
        for n in range(3):
            best[a, b] = min(best.get((a, b), (cost + 3 * n, label + "I" * n)), (cost + 3 * n, label + "I" * n))
            b = ASSISTANT if b == USER else USER
    return [(a, b, cost, label) for (a, b), (cost, label) in best.items()]


def row_edges(initial: str, fault: int) -> Edges:
    """Ways past one row, inserted turns after it included."""
    out: Edges = [(s, s, 4, "D") for s in range(4)]
    if fault in (FINE, TRUNCATED):
        more = 3 * (fault == TRUNCATED)
        for (a, role), b in NEXT.items():
            if initial == role:
                out.append((a, b, more, "K"))
            elif role != "s":
                out.append((a, b, 3 + more, "R"))
    return _inserted(out)


BEFORE = _inserted([(s, s, 0, "") for s in range(4)])
EDGES = {(i, f): row_edges(i, f) for i in ("s", "u", "a", "") for f in FAULTS}


class Node:
    __slots__ = ("depth", "kids", "label", "state", "up")

    def __init__(self, up: Node | None, label: str, state: int) -> None:
        self.up, self.label, self.state, self.kids = up, label, state, set()
        self.depth = up.depth + 1 if up else 0


class Survivors:
    """Best way into each state; letters that all survivors share have left the tree."""

    def __init__(self, state: int) -> None:
        self.root = Node(None, "", state)
        self.best: dict[int, tuple[int, Node]] = {state: (0, self.root)}
        self.settled: list[tuple[str, int]] = []  # letters of a step and the state after it

    def step(self, edges: Edges) -> None:
        new: dict[int, tuple[int, Node, str]] = {}
        for a, b, more, label in edges:
            if a in self.best:
                cost, node = self.best[a]
                way = (cost + more, node, label)
                if b not in new or way[0] < new[b][0] or (way[0] == new[b][0] and self._before(way, new[b])):
                    new[b] = way
        if ASSISTANT in new:
            for state, less in ((NOTHING, 4), (SYSTEM, 0)):
                if state in new and new[state][0] > new[ASSISTANT][0] + less:
                    del new[state]
        old = [node for _, node in self.best.values()]
        self.best = {}
        for b, (cost, node, label) in new.items():
            kid = Node(node, label, b)
            node.kids.add(kid)
            self.best[b] = (cost, kid)
        for node in old:
            while not node.kids and node.up:
                node.up.kids.discard(node)
                node = node.up
        while len(self.root.kids) == 1:
            (kid,) = self.root.kids
            self.settled.append((kid.label, kid.state))
            kid.up = None
            self.root = kid

    @staticmethod
    def _before(x: tuple[int, Node, str], y: tuple[int, Node, str]) -> bool:
        """Are x's letters less than y's? Only those after the node where they part are read."""
        (_, a, x_last), (_, b, y_last) = x, y
        x_parts, y_parts = [x_last], [y_last]
        while a is not b:
            if a.depth >= b.depth:
                x_parts.append(a.label)
                a = a.up
            else:
                y_parts.append(b.label)
                b = b.up
        return "".join(reversed(x_parts)) < "".join(reversed(y_parts))

    def path(self, state: int) -> list[tuple[str, int]]:
        """Letters of and state after every step of a survivor."""
        node, steps = self.best[state][1], []
        while node is not self.root:
            steps.append((node.label, node.state))
            node = node.up
        return [*self.settled, *reversed(steps)]

    def ways(self) -> dict[int, tuple[int, str]]:
        """Cost and all letters of each survivor."""
        return {state: (cost, "".join(letters for letters, _ in self.path(state))) for state, (cost, _) in self.best.items()}

    def end(self) -> tuple[int, str, int]:
        """Cost, letters and state of the best survivor in which a conversation may end."""
        return min((*way, state) for state, way in self.ways().items() if state in ENDS)


def initial_of(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else ""


def rows_of(lines: list[tuple[str, str, int, int]]) -> Iterator[tuple[str, str, int]]:
    """(role, text, fault) of every row of counted lines (role, text, repeats, fault of the first)."""
    for role, text, n, fault in lines:
        yield role, text, fault
        for _ in range(n - 1):
            yield role, text, BLANK if fault == BLANK else DUPLICATE


def search(lines: list[tuple[str, str, int, int]], state: int = STARTS, first: bool = True) -> Survivors:
    found = Survivors(state)
    if first:
        found.step(BEFORE)
    for role, _, fault in rows_of(lines):
        found.step(EDGES[initial_of(role), fault])
    return found


def replay(lines: list[tuple[str, str, int, int]], letters: str, state: int) -> Iterator[tuple[str | None, str | None, str]]:
    """(role, text, edit) of each edit; role and text of what it leaves, null for a deleted row."""
    rows = rows_of(lines)
    for edit in letters:
        if edit == "I":
            role, text = NAMES[ASSISTANT if state == USER else USER], ""
        else:
            role, text, _ = next(rows)
            if edit == "D":
                yield None, None, edit
                continue
            if edit == "R":
                role = NAMES[ASSISTANT if state == USER else USER]
        state = NEXT[state, role[0]]
        yield role, text, edit


def breaks(lines: list[tuple[str, str, int, int]]) -> int:
    """Neighbouring rows whose roles do not follow each other."""
    roles = [role[:1] for role, _, n, _ in lines if n]
    return sum(n - 1 for *_, n, _ in lines if n) + sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


LINE, ROW = ["role", "text", "n", "fault"], ["turn", "role", "text", "n"]
TURNS = T.StructType([T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])
FOUND = T.StructType([*[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
WAYS = T.StructType([T.StructField("illegal", T.LongType()), T.StructField("first_role", T.StringType()), T.StructField("last_role", T.StringType()), T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("letters", T.StringType())])


def grouped(df: DataFrame, key: list[str], fields: list[str], out: T.StructType, make: Callable[[tuple, list[tuple]], list[tuple]]) -> DataFrame:
    """make(key, rows) for every run of equal keys of sorted partitions; holds one group at a time."""
    schema = T.StructType([df.schema[k] for k in key] + list(out.fields))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.field(n, _kind(f.dataType)) for n, f in zip(names, schema.fields, strict=True)]
        held, rows, ready = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in ready], type=k.type) for j, k in enumerate(kinds)], names=names)
                ready.clear()

        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in key], strict=True))
            for k, row in zip(keys, zip(*[batch.column(f).to_pylist() for f in fields], strict=True), strict=True):
                if held is not None and k != held:
                    ready += [(*held, *r) for r in make(held, rows)]
                    rows = []
                    if len(ready) >= 1024:
                        yield from flush()
                held = k
                rows.append(row)
        if held is not None:
            ready += [(*held, *r) for r in make(held, rows)]
        yield from flush()

    return df.select(*key, *fields).mapInArrow(run, schema)


def _kind(t: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "date": pa.date32()}[t.simpleString()]


def rows_by_conversation(turns: DataFrame, repeats: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, n (how often the row counts) of turns, nulls of role and text as one space."""
    blank = F.lit(" ")
    return turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.lit(1) if repeats is None else repeats).cast("long").alias("n"))


_SPACE = " \t\n\v\f\r"


def counted(rows: list[tuple]) -> list[tuple[str, str, int, int]]:
    """Counted lines (role, text, repeats, fault of the first) of the sorted rows (turn, role, text, repeats) of a conversation."""
    out: list[tuple[str, str, int, int]] = []
    seen, last = set(), None
    for turn, role, text, n in rows:
        if n and (turn, role, text) == last:
            out[-1] = (*out[-1][:2], out[-1][2] + n, out[-1][3])
        elif n:
            bare = text.rstrip(_SPACE)
            out.append((role, text, n, BLANK if not bare else DUPLICATE if (role, text) in seen else FINE if bare[-1] in ".!?" else TRUNCATED))
            seen.add((role, text))
            last = (turn, role, text)
    return out


def lines_of(rows: DataFrame) -> DataFrame:
    """Counted lines (conv_id, turn, role, text, n, fault) of rows_by_conversation's rows."""
    lines = materialize(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")))
    same = [F.xxhash64("role", "text").alias("__a"), F.xxhash64(F.lit(1), "text", "role").alias("__b")]  # 128 bits tell texts apart
    there = lines.where("n > 0").select("conv_id", *same, F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn").alias("at")).alias("__turn"))
    firsts = there.groupBy("conv_id", "__a", "__b").agg(F.min("__turn").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    l, r = lines.select("*", *same).alias("l"), firsts.alias("r")
    on = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.__a") == F.col("r.__a")) & (F.col("l.__b") == F.col("r.__b"))
    seen = F.col("r.__first").isNotNull() & ~(F.col("l.turn").eqNullSafe(F.col("r.__first.at")))
    fault = F.when(~F.col("l.text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(seen, DUPLICATE).when(~F.col("l.text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)
    return l.join(r, on, "left").select(*[F.col(f"l.{c}") for c in lines.columns], fault.alias("fault"))


class Repair:
    """What repair and repaired_turns share: counted lines, short conversations, long ones by block."""

    def __init__(self, turns: DataFrame, repeats: Column | None, block: int) -> None:
        rows = rows_by_conversation(turns, repeats)
        sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__rows"))
        large = materialize(sizes.where(F.col("__rows") > block).select(F.col("conv_id").alias("__conv"), F.lit(True).alias("__long")))  # all rows / block at most
        self.has_long = not large.isEmpty()
        if self.has_long:
            joined = rows.join(large, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
            rows, long = joined.where("__long is null").drop("__long"), joined.where("__long").drop("__long")
            self._read_long(lines_of(long), block)
        self.short = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def _read_long(self, lines: DataFrame, block: int) -> None:
        lines = materialize(lines)
        n, fault = F.col("n"), F.col("fault")
        first = lambda f: F.sum(F.when(fault == f, 1).otherwise(0) * (n > 0).cast("int"))
        turn = F.when(n > 0, F.col("turn"))
        self.stats = materialize(
            lines.groupBy("conv_id").agg(
                F.sum((n > 0).cast("long")).alias("n_lines"), F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
                F.sum(F.when(fault == BLANK, n).otherwise(0)).alias("blank"), F.sum(F.when(fault == BLANK, 0).when(fault == DUPLICATE, n).otherwise(F.greatest(n - 1, F.lit(0)))).alias("duplicate"), first(TRUNCATED).alias("truncated"),
            )
        )
        there = lines.where("n > 0")
        placed = running(there, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")], F.lit(1), self.stats.agg(F.sum("n_lines")).first()[0] or 0, "__at")
        begin = placed.groupBy(F.col("conv_id").alias("__conv")).agg(F.min("__at").alias("__begin"))
        self.long = materialize(placed.join(begin, F.col("conv_id").eqNullSafe(F.col("__conv"))).withColumn("__block", F.floor((F.col("__at") - F.col("__begin")) / block)).drop("__conv", "__begin"))
        self.choice = self._choose()

    def blocks(self, extra: DataFrame | None = None) -> DataFrame:
        rows = self.long if extra is None else self.long.unionByName(extra, allowMissingColumns=True)
        return rows.repartition("conv_id", "__block").sortWithinPartitions("conv_id", "__block", "__at")

    def _choose(self) -> DataFrame:
        """For each block of a long conversation the letters chosen, the state and position at its beginning; one more row, __block -1, has cost, audit and breaks."""

        def ways(key: tuple, lines: list[tuple]) -> list[tuple]:
            out = []
            for entry in range(4):
                for last, (cost, letters) in search(lines, entry, key[1] == 0).ways().items():
                    out.append((breaks(lines), lines[0][0], lines[-1][0], entry, last, cost, letters))
            return out

        def chain(_: tuple, rows: list[tuple]) -> list[tuple]:
            by: dict[int, list[tuple]] = {}
            for r in rows:
                by.setdefault(r[0], []).append(r[1:])
            found, illegal, before = Survivors(STARTS), 0, None
            for number in sorted(by):
                found.step([(entry, last, cost, letters) for *_, entry, last, cost, letters in by[number]])
                inside, first, last_role = by[number][0][:3]
                illegal += inside + (before is not None and before[:1] + first[:1] not in ("su", "ua", "au"))
                before = last_role
            cost, audit, end = found.end()
            out, state, place = [(-1, 0, 0, cost, illegal, audit)], STARTS, 0
            for number, (letters, last) in zip(sorted(by), found.path(end), strict=True):
                out.append((number, state, place, 0, 0, letters))
                state, place = last, place + len(letters) - letters.count("D")
            return out

        out = T.StructType([T.StructField("__block", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("letters", T.StringType())])
        found = materialize(grouped(self.blocks(), ["conv_id", "__block"], LINE, WAYS, ways))
        return materialize(grouped(found.repartition("conv_id").sortWithinPartitions("conv_id", "__block"), ["conv_id"], ["__block", *WAYS.names], out, chain))

    def replayed(self, out: T.StructType, make: Callable[[list[tuple], str, int, int], list[tuple]]) -> DataFrame:
        """make(lines, letters, state, position) for each block of the long conversations; the letters travel as one more row of the block."""
        extra = self.choice.where("__block >= 0").select("conv_id", "__block", F.lit(-1).cast("long").alias("__at"), F.col("letters").alias("text"), F.col("entry").alias("fault"), F.col("place").alias("n"))
        return grouped(self.blocks(extra), ["conv_id", "__block"], LINE, out, lambda _, rows: make(rows[1:], rows[0][1], rows[0][3], rows[0][2]))

    def conversations(self) -> DataFrame:
        def whole(_: tuple, rows: list[tuple]) -> list[tuple]:
            lines = counted(rows)
            turns = {turn for turn, *_, n in rows if n and turn is not None}
            faults = [fault for *_, fault in rows_of(lines)]
            cost, audit, _ = search(lines).end()
            digest = hashlib.sha256(_text(lines, audit, STARTS).encode("utf-8", "replace")).hexdigest()
            return [(max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, (BLANK, DUPLICATE, TRUNCATED)), breaks(lines), cost, audit, digest)]

        out = grouped(self.short, ["conv_id"], ROW, FOUND, whole)
        if not self.has_long:
            return out
        parts = materialize(self.replayed(T.StructType([T.StructField("part", T.StringType())]), lambda lines, letters, state, _: [(_text(lines, letters, state),)] if set(letters) - {"D"} else []))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        hashes = hashed(parts).withColumnRenamed("conv_id", "__id")
        totals = self.choice.where("__block = -1").select(F.col("conv_id").alias("__conv"), "cost", F.col("letters").alias("audit"), "illegal")
        long = self.stats.join(totals, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
        nothing = F.lit(hashlib.sha256().hexdigest())
        return out.unionByName(long.select("conv_id", "gaps", "blank", "duplicate", "truncated", zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")))

    def turns(self) -> DataFrame:
        def rows(lines: list[tuple], letters: str, state: int, place: int) -> list[tuple]:
            kept = [r for r in replay(lines, letters, state) if r[2] != "D"]
            return [(place + i, *r) for i, r in enumerate(kept)]

        out = grouped(self.short, ["conv_id"], ROW, TURNS, lambda _, found: rows(lines := counted(found), search(lines).end()[1], STARTS, 0))
        return out.unionByName(self.replayed(TURNS, rows).drop("__block")) if self.has_long else out


def _text(lines: list[tuple], letters: str, state: int) -> str:
    return "\n".join(f"{role}:{text}" for role, text, edit in replay(lines, letters, state) if edit != "D")


def hashed(parts: DataFrame) -> DataFrame:
    """sha256 of each conversation's parts, joined by newlines in the order of blocks: a stream, one part in memory at a time."""
    schema = T.StructType([parts.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.field(f.name, _kind(f.dataType)) for f in schema.fields]
        held, digest = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                conv, part = batch.column("conv_id")[i].as_py(), batch.column("part")[i].as_py()
                if digest is not None and conv == held:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([held], kinds[0].type), pa.array([digest.hexdigest()])], names=schema.names)
                    held, digest = conv, hashlib.sha256()
                digest.update(part.encode("utf-8", "replace"))
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], kinds[0].type), pa.array([digest.hexdigest()])], names=schema.names)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "__block").select("conv_id", "part").mapInArrow(run, schema)


def repair(turns: DataFrame, repeats: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit (letters of the cheapest edits) and repaired_sha256."""
    return Repair(turns, repeats, block).conversations()


def repaired_turns(turns: DataFrame, repeats: Column | None = None, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text and the edit (K, R or I) that each turn comes from."""
    return Repair(turns, repeats, block).turns()
