"""Repair of conversation structure: the cheapest edits, by Dijkstra's search from both ends."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed, tasks

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
ROLES = {"u": "user", "a": "assistant"}
# Where a repaired conversation may stand: nothing yet, after its system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER},
}
BEFORE = {
    state: [(before, role) for before, to in NEXT.items() for role, after in to.items() if after == state]
    for state in range(4)
}
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
# Turns and bytes of text in one part of a conversation.
PART_TURNS = 256
PART_BYTES = 1 << 20
BATCH_BYTES = 1 << 22

# A column of the edit lattice: an initial and whether the turn is truncated, or a number of turns that must go.
Column = tuple[str, bool] | int
Label = tuple[int, str]


def _forward(columns: tuple[Column, ...], at: int, state: int, closed: bool) -> Iterator[tuple[int, str, int, int]]:
    """Edits from a node of the lattice: (cost, letters, column after, state after)."""
    for role, after in NEXT[state].items():
        if role != "s" and not (closed and at == len(columns)):
            yield INSERT, "I", at, after
    if at == len(columns):
        return
    column = columns[at]
    if isinstance(column, int):
        yield DELETE * column, "D" * column, at + 1, state
        return
    initial, truncated = column
    yield DELETE, "D", at + 1, state
    extra = TRUNCATED * truncated
    for role, after in NEXT[state].items():
        if role == initial:
            yield extra, "K", at + 1, after
        elif role != "s":
            yield extra + REROLE, "R", at + 1, after


def _backward(columns: tuple[Column, ...], at: int, state: int, closed: bool) -> Iterator[tuple[int, str, int, int]]:
    """Edits that lead to a node: (cost, letters, column before, state before)."""
    for before, role in BEFORE[state]:
        if role != "s" and not (closed and at == len(columns)):
            yield INSERT, "I", at, before
    if not at:
        return
    column = columns[at - 1]
    if isinstance(column, int):
        yield DELETE * column, "D" * column, at - 1, state
        return
    initial, truncated = column
    yield DELETE, "D", at - 1, state
    extra = TRUNCATED * truncated
    for before, role in BEFORE[state]:
        if role == initial:
            yield extra, "K", at - 1, before
        elif role != "s":
            yield extra + REROLE, "R", at - 1, before


def cheapest(columns: tuple[Column, ...], first: int, last: tuple[int, ...], closed: bool = False) -> Label | None:
    """Cost and letters of the cheapest edits from state ``first`` to one of ``last``; of equal costs the least letters.

    With ``closed`` nothing is inserted after the last column. None if no edits lead there.

    Two searches meet, one from each end. Nodes leave a heap by cost, then by
    column in the direction of the search, then by letters: edits without cost
    only lead on to the next column, so a node's least letters are known when
    it leaves. Two edits of equal cost that lead to one node never begin alike
    to the end of one of them (the longer would be dearer by its insertions), so
    least parts make a least whole. The searches go on until no unfinished
    crossing can cost as little as the best; all of that cost are compared.
    """
    n = len(columns)
    labels: tuple[dict, dict] = ({(0, first): (0, "")}, {(n, state): (0, "") for state in last})
    settled: tuple[set, set] = (set(), set())
    heaps = ([(0, 0, "", first)], [(0, 0, "", state) for state in last])
    best: Label | None = None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        side = 0 if len(heaps[0]) <= len(heaps[1]) else 1
        own, other = labels[side], labels[1 - side]
        cost, gone, letters, state = heapq.heappop(heaps[side])
        at = n - gone if side else gone
        if (at, state) in settled[side]:
            continue
        settled[side].add((at, state))
        edges = (_backward if side else _forward)(columns, at, state, closed)
        for price, edit, to, after in edges:
            label = cost + price, edit + letters if side else letters + edit
            node = to, after
            if node in settled[side] or node in own and own[node] <= label:
                continue
            own[node] = label
            heapq.heappush(heaps[side], (label[0], n - to if side else to, label[1], after))
            if node in other:
                best = _least(best, label, other[node], side)
        if (at, state) in other:
            best = _least(best, (cost, letters), other[at, state], side)
    return best


def _least(best: Label | None, own: Label, other: Label, side: int) -> Label:
    crossing = own[0] + other[0], other[1] + own[1] if side else own[1] + other[1]
    return crossing if best is None or crossing < best else best


@lru_cache(maxsize=1 << 14)
def _repair(columns: tuple[Column, ...]) -> Label:
    return cheapest(columns, START, ENDS)


def _ways(columns: tuple[Column, ...], first: tuple[int, ...]) -> list[dict]:
    """The cheapest edits between each two states, without insertions at the end, which belong to the next part."""
    found = ((a, b, cheapest(columns, a, (b,), closed=True)) for a in first for b in range(4))
    return [{"enter": a, "leave": b, "cost": label[0], "audit": label[1]} for a, b, label in found if label]


def joined_ways(parts: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, str]]:
    """Of the ways (from, to, cost, letters) through each part in turn, those of the cheapest whole: (from, cost, letters).

    Only costs and ranks are carried on: as no part ends with an insertion,
    the letters up to a border that lead to two states differ before either
    ends, and so does their order whatever follows. Insertions that the whole
    ends with are added to the last part.
    """
    reached = {START: (0, 0)}
    steps: list[dict[int, tuple[int, int, str]]] = []
    for ways in parts:
        least: dict[int, tuple] = {}
        for before, state, cost, letters in ways:
            if before in reached:
                so_far, rank = reached[before]
                found = so_far + cost, rank, letters, before, cost
                least[state] = min(least.get(state, found), found)
        order = sorted(least, key=lambda state: least[state][1:])
        reached = {state: (least[state][0], rank) for rank, state in enumerate(order)}
        steps.append({state: (before, cost, letters) for state, (_, _, letters, before, cost) in least.items()})
    closing = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
    state = min(reached, key=lambda state: (reached[state][0] + INSERT * closing[state], reached[state][1]))
    out, inserted = [], closing[state]
    for step in reversed(steps):
        state, cost, letters = step[state]
        out.append((state, cost + INSERT * inserted, letters + "I" * inserted))
        inserted = 0
    return out[::-1]


def repaired_turns(state: int, letters: str, turns: list[tuple[str, str, int]]) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) that edits leave of ``turns`` (role, text, copies), and the state after them."""
    out: list[tuple[str, str]] = []
    left = (turn for turn in turns for _ in range(turn[2]))
    for letter in letters:
        role, text = (None, "") if letter == "I" else next(left)[:2]
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = NEXT[state][role[0]]
        out.append((role, text))
    return out, state


class Part:
    """Consecutive turns of one conversation, as a task reads them."""

    def __init__(self, conv_id: int | None, number: int, most_turns: int):
        self.conv_id, self.number, self.most_turns = conv_id, number, most_turns
        self.turns: list[tuple[str, str, int]] = []
        self.columns: list[Column] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.bytes = 0
        self.low: int | None = None
        self.high: int | None = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        initial = role[:1]
        follows = bool(self.turns) and self.turns[-1][0][:1] + initial in LEGAL
        self.counts["illegal"] += copies - 1 + (bool(self.turns) and not follows)
        words = text.strip(" \t\n\v\f\r")
        if not words:
            self.counts["blank"] += copies
            gone = copies
        else:
            gone = copies - first
            self.counts["duplicate"] += gone
            if first:
                truncated = words[-1] not in ".!?"
                self.counts["truncated"] += truncated
                self.columns.append((initial, truncated))
        if gone and self.columns and isinstance(self.columns[-1], int):
            self.columns[-1] += gone
        elif gone:
            self.columns.append(gone)
        self.turns.append((role, text, copies))
        self.bytes += len(text)

    @property
    def full(self) -> bool:
        return len(self.turns) >= self.most_turns or self.bytes >= PART_BYTES

    def row(self, whole: bool, opens: bool) -> dict:
        columns = tuple(self.columns)
        row = {
            "conv_id": self.conv_id, "part": self.number, "whole": whole, **self.counts,
            "gaps": _gaps(self.low, self.high, self.distinct), "low": self.low, "high": self.high, "distinct": self.distinct,
            "opening": self.turns[0][0][:1], "closing": self.turns[-1][0][:1],
            "cost": None, "audit": None, "turns": None, "given": None, "ways": None,
        }
        if whole:
            cost, letters = _repair(columns)
            turns = repaired_turns(START, letters, self.turns)[0]
            return row | {"cost": cost, "audit": letters, "turns": _named(turns)}
        given = [dict(zip(("role", "text", "copies"), turn)) for turn in self.turns]
        return row | {"given": given, "ways": _ways(columns, (START,) if opens else (START, SYSTEM, USER, ASSISTANT))}


def _named(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in turns]


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else min(high - low + 1 - distinct, 2**63 - 1)


def _schema(text: str) -> pa.Schema:
    """The Arrow schema of a list of Spark columns with the types used here."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds["turns"] = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds["given"] = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))
    way = [("enter", pa.int64()), ("leave", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
    kinds["ways"] = pa.list_(pa.struct(way))
    columns = [part.split(" ", 1) for part in text.split(", ")]
    return pa.schema([(name, kinds.get(name, kinds.get(kind))) for name, kind in columns])


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(t["text"]) for name in ("turns", "given") for t in row.get(name) or [])
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            yield from batch.slice(at, 64).to_pylist()


def cut_to_parts(batches: Iterator[pa.RecordBatch], part_turns: int) -> Iterator[pa.RecordBatch]:
    """Turns in order as parts; a conversation that lies inside the task and fits one part is repaired at once.

    Of the first and the last conversation of a task others may hold more.
    """

    def parts() -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        part, first_of_task, first_of_conversation = None, True, True
        for row in _rows(batches):
            other = part is not None and row["conv_id"] != part.conv_id
            if part is None or other or part.full:
                if part is not None:
                    opens = first_of_conversation and not first_of_task
                    yield part.row(opens and other, opens)
                    first_of_conversation = other
                    first_of_task = first_of_task and not other
                part, number = Part(row["conv_id"], number, part_turns), number + 1
            part.add(row["turn"], row["role"], row["text"], row["copies"], row["first"])
        if part is not None:
            yield part.row(False, first_of_conversation and not first_of_task)

    yield from _batches(parts(), _schema(PARTS))


def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each part, from the ways of all parts of its conversation, which come in order.

    A task holds the ways of one conversation, a few letters for each turn,
    but none of its texts.
    """

    def choices(parts: list[dict]) -> Iterator[dict]:
        ways = [[(w["enter"], w["leave"], w["cost"], w["audit"]) for w in part["ways"]] for part in parts]
        low = high = closing = None
        distinct = 0
        rows = []
        for part, (before, cost, audit) in zip(parts, joined_ways(ways)):
            row = {"part": part["part"], "before": before, "audit": audit, "cost": cost, "gaps": 0}
            row["border"] = int(closing is not None and closing + part["opening"] not in LEGAL)
            closing = part["closing"]
            if part["low"] is not None:
                distinct += part["distinct"] - (high == part["low"])
                low, high = part["low"] if low is None else low, part["high"]
            rows.append(row)
        rows[0]["gaps"] = _gaps(low, high, distinct)
        yield from rows

    def all_choices() -> Iterator[dict]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield from choices(held)
                held = []
            held.append(row)
        if held:
            yield from choices(held)

    yield from _batches(all_choices(), _schema(CHOICES))


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that the edits of each part leave."""

    def repaired() -> Iterator[dict]:
        for row in _rows(batches):
            given = [(t["role"], t["text"], t["copies"]) for t in row.pop("given")]
            row["turns"] = _named(repaired_turns(row.pop("before"), row["audit"], given)[0])
            yield row

    yield from _batches(repaired(), _schema(REPAIRED))


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
TURNS = "turns array<struct<role:string,text:string>>"
REPAIRED = f"conv_id bigint, part bigint, whole boolean, {COUNTS}, cost bigint, audit string, {TURNS}"
PARTS = (
    f"{REPAIRED}, low bigint, high bigint, distinct bigint, opening string, closing string, "
    "given array<struct<role:string,text:string,copies:bigint>>, "
    "ways array<struct<enter:bigint,leave:bigint,cost:bigint,audit:string>>"
)
DIGESTS = f"conv_id bigint, {COUNTS}, cost bigint, audit string, repaired_sha256 string"
CHOICES = "part bigint, before bigint, audit string, cost bigint, border bigint, gaps bigint"


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """Conversations cut, relabelled and filled until their roles read system at most once, then user and assistant by turns.

    One row per part of a conversation: ``conv_id``, ``part`` (numbers that rise
    along the conversation), ``whole`` (whether it is the only part), ``gaps``,
    ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` (a letter per edit) and
    ``turns``, what is left with ``role`` and ``text``. Numbers are those of the part, so
    that they add up over a conversation; ``gaps`` stands with its first part.

    A conversation's rows are taken by turn, nulls first, then by role and
    text. A null role or text counts as one blank; a null ``conv_id`` is a
    conversation of its own. Repeated rows are turns of their own, all but the
    first duplicates. Roles count by their first letter. Numbers beyond a bigint
    count as its end. An empty table gives no rows.

    Each row's first fault counts: blank (nothing but white space), duplicate
    (role and text seen earlier), truncated (the last character is none of
    ``.!?``). Edits: Keep costs 0, Rerole 1, Delete 2, which blank and duplicate
    rows must be, Insert 5; a truncated row that stays costs 5 more. Those of the least
    cost are taken, of equal ones the least letters; see :func:`cheapest`.

    Rows are counted by turn, role and text before they meet, and dealt out by
    ranges of the order above, so a long conversation lies in many tasks. Parts
    have ``part_turns`` different rows at most. A conversation in several parts is settled by
    the ways through each between any two states; one task takes these in turn,
    some letters for every turn, without texts.
    """
    key = ["conv", "no_conv", "at", "no_turn", "role", "digest"]
    conv, turn = F.col("conv_id"), F.col("turn")
    slim = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    keyed = slim.select(
        F.coalesce(conv, F.lit(0)).alias("conv"), conv.isNull().alias("no_conv"),
        F.coalesce(turn, F.lit(0)).alias("at"), turn.isNull().alias("no_turn"), "role", F.md5("text").alias("digest"), "text",
    )
    rows = keyed.groupBy(*key).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # False before true would put null turns last.
    earliest = F.min(F.struct((~F.col("no_turn")).alias("has_turn"), "at"))
    firsts = keyed.groupBy("conv", "no_conv", "role", "digest").agg(earliest.alias("least")).select(
        "conv", "no_conv", F.col("least.at").alias("at"), (~F.col("least.has_turn")).alias("no_turn"), "role", "digest",
        F.lit(True).alias("first"),
    )
    marked = rows.join(firsts, key, "left").select(
        F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), F.when(~F.col("no_turn"), F.col("at")).alias("turn"),
        "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"),
    )
    spread = marked.repartitionByRange(tasks(turns.sparkSession), "conv_id", "turn", "role", F.substring("text", 1, 64))
    placed = spread.sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = checkpointed(placed.mapInArrow(lambda batches: cut_to_parts(batches, part_turns), PARTS))
    names = [part.split()[0] for part in REPAIRED.split(", ")]

    several = parts.where(~F.col("whole"))
    slim_parts = several.select("conv_id", "part", "low", "high", "distinct", "opening", "closing", "ways")
    choices = slim_parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(decided, CHOICES)
    chosen = several.drop("audit", "cost", "gaps", "turns").join(choices, "part")
    counted = chosen.withColumn("illegal", F.col("illegal") + F.col("border"))
    of_several = counted.select(*[c for c in names if c != "turns"], "before", "given").mapInArrow(applied, REPAIRED)
    return parts.where("whole").select(*names).unionByName(of_several)


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair_conversations`: its numbers, ``audit`` and ``repaired_sha256``.

    The digest is that of ``role:text`` of all turns, joined by newlines. It can
    only be taken in order, so the parts of a long conversation are read one
    after the other by one task, which holds a batch of them and the audit.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    single = repaired.where("whole").withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).select(*names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[dict]:
            row, digest, audit = None, hashlib.sha256(), []
            for part in _rows(batches):
                if row is None or part["conv_id"] != row["conv_id"]:
                    if row is not None:
                        yield row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                    row, digest, audit = {"conv_id": part["conv_id"], **dict.fromkeys(names[1:7], 0)}, hashlib.sha256(), []
                    first = True
                for name in names[1:7]:
                    row[name] += part[name]
                audit.append(part["audit"])
                for turn in part["turns"]:
                    digest.update(("" if first else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
                    first = False
            if row is not None:
                yield row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        yield from _batches(conversations(), _schema(DIGESTS))

    parts = repaired.where(~F.col("whole")).select(*names[:-1], "part", "turns")
    in_order = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return single.unionByName(in_order.mapInArrow(summed, DIGESTS))
