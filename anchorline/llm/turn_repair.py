"""Repair of a conversation's structure at least cost, by Hirschberg's divide and conquer.

A conversation shall read `(s?(ua)+)?` in the initials of its roles: an optional system message, then user and assistant
in turn, or nothing at all. Each message is kept (cost 0), given the role that is due (1) or deleted (2), and empty
messages with the role that is due may be inserted anywhere (5). Blank messages and repeats of an earlier role and text
have to be deleted; a truncated message that stays costs 5 more. Among the cheapest repairs the one whose audit, the
initials of its edits in order, comes first in ASCII counts.

What has been read of the pattern is one of four states: nothing, a system message, a user, an assistant. For each
half of a stretch of messages four costs are enough: forward from its start, backward from its end. They meet in
the middle; the cheapest crossing is chosen, and both sides are solved alike. Audits need no strings: two audits up
to the same message end with an edit of it, so neither continues the other, and forward costs carry the order of the four
audits along. The crossing whose audit comes first is that of the whole.

A task reads the messages of its conversations in order and keeps one byte for each message of one conversation; texts
stream past a second time when the edits are known. One endless conversation therefore takes one task, but no
memory for its texts.

Messages follow each other by turn (null first), then role, then text. Null roles and texts count as one space.
Null ids are one conversation. A message is blank without a character other than white space (ASCII), truncated if the
last such character is none of `.!?`; the first of blank, duplicate, truncated counts. A role that is empty or begins
otherwise cannot be kept. Repeated rows are duplicates. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.session import stable

#: States: nothing read yet, a system message, a user, an assistant; the state after the role that is due in each.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
RELABEL, DELETE, INSERT, LATE = 1, 2, 5, 5
#: A message in one byte: the state its role leads to (0 if none) and its faults.
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
FAR = 1 << 60
SPACE = " \t\n\x0b\x0c\r"


def kept_from(state: int, role: int) -> bool:
    """Whether a message whose role leads to the state `role` may follow in `state`."""
    return role == SYSTEM and state == START or role in (USER, ASSISTANT) and DUE[state] == role


@lru_cache(maxsize=None)
def steps(message: int) -> tuple[tuple[int, int, int, str], ...]:
    """(before, after, cost, edits): the cheapest way over one message, inserts ahead of it included, for each two states
    that it can lie between."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    late = LATE if message & TRUNCATED else 0
    for before in range(4):
        state, cost, edits = before, 0, ""
        for _ in range(4):  # more inserts come round to a state that was cheaper before
            ways = [(state, DELETE, "D")]
            if not message & (BLANK | DUPLICATE):
                ways.append((DUE[state], RELABEL + late, "R"))
                if kept_from(state, message & 3):
                    ways.append((message & 3, late, "K"))
            for after, more, edit in ways:
                made = (cost + more, edits + edit)
                best[before, after] = min(best.get((before, after), (FAR, "")), made)
            state, cost, edits = DUE[state], cost + INSERT, edits + "I"
    return tuple((a, b, cost, edits) for (a, b), (cost, edits) in sorted(best.items()))


#: Inserts that close a conversation in each state, and what they cost.
CLOSING = ("", "II", "I", "")


def forward(messages: bytes, low: int, high: int, start: int) -> tuple[list[int], list[int]]:
    """Costs from `start` before message `low` to each state after message `high - 1`, and the order of their audits."""
    costs, order = [FAR] * 4, [0] * 4
    costs[start] = 0
    for i in range(low, high):
        best: list[tuple | None] = [None] * 4
        for a, b, cost, edits in steps(messages[i]):
            if costs[a] < FAR:
                made = (costs[a] + cost, order[a], edits)
                if best[b] is None or made < best[b]:
                    best[b] = made
        ranked = sorted(x[1:] for x in best if x)
        costs = [x[0] if x else FAR for x in best]
        order = [ranked.index(x[1:]) if x else 4 for x in best]
    return costs, order


def backward(messages: bytes, low: int, high: int, ending: list[int]) -> list[int]:
    """Costs from each state before message `low` to the end of the stretch, whose states cost `ending`."""
    costs = ending
    for i in range(high - 1, low - 1, -1):
        ahead, costs = costs, [FAR] * 4
        for a, b, cost, _ in steps(messages[i]):
            costs[a] = min(costs[a], cost + ahead[b])
    return costs


def repair(messages: bytes) -> tuple[int, str]:
    """Least cost and its first audit of the messages of a conversation."""
    closing = [INSERT * len(x) for x in CLOSING]
    out: list[str] = []
    total = None
    todo = [(0, len(messages), START, closing)]
    while todo:  # stretches from left to right
        low, high, start, ending = todo.pop()
        if high - low == 1:
            ways = [(cost + ending[b], edits, b) for a, b, cost, edits in steps(messages[low]) if a == start]
            cost, edits, after = min(w for w in ways)
            out.append(edits)
            total = cost if total is None else total
            if high == len(messages):
                out.append(CLOSING[after])
            continue
        if high == low:
            return closing[START], CLOSING[START]
        middle = (low + high) // 2
        ahead, order = forward(messages, low, middle, start)
        behind = backward(messages, middle, high, ending)
        cost, _, crossing = min((a + b, o, s) for s, (a, b, o) in enumerate(zip(ahead, behind, order, strict=True)))
        total = cost if total is None else total
        todo.append((middle, high, crossing, ending))
        todo.append((low, middle, start, [0 if s == crossing else FAR for s in range(4)]))
    return total, "".join(out)


def typed(
    messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, turn, place, role, text, kind), written once: the place of each message in its conversation, and the message
    in one byte. The id deals the rows; first places and repeats are found where they lie."""
    said = messages.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
    ).repartition("id")
    begins, last = F.substring("role", 1, 1), F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    role = F.when(begins == "s", SYSTEM).when(begins == "u", USER).when(begins == "a", ASSISTANT).otherwise(0)
    turn = F.col("turn").asc_nulls_first()
    place = F.row_number().over(Window.partitionBy("id").orderBy(turn, "role", "text"))
    nth = F.row_number().over(Window.partitionBy("id", "role", "text").orderBy("place"))
    fault = F.when(last == "", BLANK).when(nth > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    placed = said.select("id", "turn", place.alias("place"), "role", "text")
    return stable(placed.withColumn("kind", role.bitwiseOR(fault)))


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class _Conversation:
    """One conversation's messages as they come."""

    def __init__(self, ident):
        self.ident, self.kinds, self.turns = ident, bytearray(), 0
        self.low = self.high = None

    def add(self, turn: int | None, kind: int) -> None:
        self.kinds.append(kind)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def summary(self) -> tuple:
        kinds = bytes(self.kinds)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        faults = [sum(bool(k & f) for k in kinds) for f in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))
        return (self.ident, gaps, *faults, illegal, *repair(kinds))


def audits(rows: DataFrame) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of `typed` rows: missing turn
    numbers, messages with each fault, neighbours whose roles may not follow each other, and the cheapest repair."""
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.select("id", "place", "turn", "kind").repartition("id").sortWithinPartitions("id", "place")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for part in parts:
            of, done = part.schema.field("id").type, []
            for ident, turn, code in zip(*(part[c].to_pylist() for c in ("id", "turn", "kind")), strict=True):
                if now is None or now.ident != ident:
                    if now is not None:
                        done.append(now.summary())
                    now = _Conversation(ident)
                now.add(turn, code)
            if done:
                yield made(done, of)
        if now is not None:
            yield made([now.summary()], of)

    def made(summaries: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        types = [of, *[pa.int64()] * 6, pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*summaries, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["id", *FIGURES])

    figures = ", ".join(f"{c} long" for c in FIGURES[:-1])
    return ordered.mapInArrow(read, f"id {kind}, {figures}, audit string")


def edited(audit: str, messages: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit leaves and makes of messages (role, text), which are read one by one."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(messages)
        if edit == "D":
            continue
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]] if edit == "K" else DUE[state]
        yield edit, role if edit == "K" else NAMES[state], text


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(id, place, edit, role, text): what is left and made of `typed` rows by the audits of `plans`. The rows of a
    conversation follow each other in one partition. Its audit comes ahead of its messages, which are read as a stream."""
    kind = rows.schema["id"].dataType.simpleString()
    heads = plans.select("id", F.lit(0).alias("place"), "audit")
    ordered = (
        rows.select("id", "place", "role", "text").unionByName(heads, allowMissingColumns=True)
        .repartition("id").sortWithinPartitions("id", "place").select("id", "audit", "role", "text")
    )

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None

        def given() -> Iterator[tuple]:
            nonlocal of
            for part in parts:
                of = part.schema.field("id").type
                yield from zip(*(part[c].to_pylist() for c in ("id", "audit", "role", "text")), strict=True)

        stream = given()
        out: list[tuple] = []
        for ident, audit, _, _ in stream:
            messages = ((role, text) for _, _, role, text in stream)  # as many as the audit has edits of messages
            for place, (edit, role, text) in enumerate(edited(audit, messages), 1):
                out.append((ident, place, edit, role, text))
                if len(out) == 256:
                    yield made(out, of)
                    out = []
        if out:
            yield made(out, of)

    def made(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        types = [of, pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "place", "edit", "role", "text"])

    return ordered.mapInArrow(read, f"id {kind}, place long, edit string, role string, text string")


def digests(left: DataFrame) -> DataFrame:
    """(id, repaired_sha256) of `repaired` rows: SHA-256 of `role:text`, joined by line feeds, as they stream past."""
    kind = left.schema["id"].dataType.simpleString()

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, of = None, None, None
        for part in parts:
            of, out = part.schema.field("id").type, []
            for ident, place, role, text in zip(*(part[c].to_pylist() for c in ("id", "place", "role", "text")), strict=True):
                if place == 1:
                    if hashed is not None:
                        out.append((now, hashed.hexdigest()))
                    now, hashed = ident, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            if out:
                yield made(out, of)
        if hashed is not None:
            yield made([(now, hashed.hexdigest())], of)

    def made(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        ids, found = zip(*out, strict=True)
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, of), "repaired_sha256": pa.array(found, pa.string())})

    return left.mapInArrow(read, f"id {kind}, repaired_sha256 string")
