"""Packing of documents into windows of a fixed size by minimum bin slack.

A document is its token ids and one closing id. Full windows are cut from its start; what remains is shorter than
a window. The remainders are packed by their lengths alone, of which there are fewer than the window has tokens:
for the longest length left, a bitset over the sums that the other lengths can reach gives the multiset closest to
the window, and the window's counts are read back from the bitsets. The same multiset fills as many windows as the
counts allow. Where the closest multiset leaves slack, everything left is longer than the slack: the most frequent
length left gives one piece of just that size to each such window, and what stays of it is a shorter remainder for later
windows. The last window is cut into powers of two, which need no padding. So no sequence is padded.

Only the table of lengths and counts (fewer rows than the window has tokens) reaches the driver. Remainders are
numbered within their length by blocks of a thousand rows, so one very frequent length is no task of its own.

Null texts are empty: the closing id alone. Repeated rows and ids are packed row by row; null ids stay null. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.llm import byte_tokens
from anchorline.llm.common import map_rows, text_of
from anchorline.session import stable

#: Rows of one numbering block, as a power of two.
BLOCK = 10


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, no more of each than counted, whose sum is the largest one within `room`;
    longer lengths are preferred among equal sums."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


@dataclass
class Use:
    """Where pieces of `size` tokens, `start` tokens into remainders of one `length`, go: those of the `count` remainders
    from index `first` on are numbered from `nth`, and `per` of them follow each other in each window."""

    length: int
    first: int
    count: int
    start: int
    size: int
    nth: int
    per: int
    sequence: int
    offset: int


@dataclass
class Plan:
    """Where the remainders of each length go, and how many sequences they fill."""

    uses: list[Use] = field(default_factory=list)
    sequences: int = 0

    def cut(self) -> int:
        """Tokens of remainders that are in pieces."""
        return sum(u.count * u.size for u in self.uses if u.size < u.length)


class Pool:
    """What is not placed yet: by length, runs (length of the remainders, first index, how many, start within them)."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c}
        self.runs = {n: [(n, 0, c, 0)] for n, c in self.left.items()}

    def take(self, length: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of together `count` rests of this length, which leave the pool."""
        self.left[length] -= count
        runs = self.runs[length]
        while count:
            origin, first, many, start = runs.pop()
            used = min(many, count)
            if used < many:
                runs.append((origin, first + used, many - used, start))
            count -= used
            yield origin, first, used, start

    def give(self, length: int, origin: int, first: int, count: int, start: int) -> None:
        self.left[length] = self.left.get(length, 0) + count
        self.runs.setdefault(length, []).append((origin, first, count, start))


def plan_windows(counts: dict[int, int], window: int) -> Plan:
    """Minimum bin slack over lengths below `window` and their counts."""
    pool, plan = Pool(counts), Plan()
    while sum(n * c for n, c in pool.left.items()) >= window:
        longest = max(n for n, c in pool.left.items() if c)
        pool.left[longest] -= 1
        fill = closest_fill(pool.left, window - longest)
        pool.left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        slack = window - sum(n * c for n, c in fill.items())
        needs = dict(fill)
        if slack:
            giver = max((n for n, c in pool.left.items() if c > fill.get(n, 0)), key=lambda n: (pool.left[n] - fill.get(n, 0), n))
            needs[giver] = needs.get(giver, 0) + 1
        repeat = min(pool.left[n] // c for n, c in needs.items())
        offset = 0
        for n in sorted(fill, reverse=True):
            nth = 0
            for origin, first, many, start in pool.take(n, fill[n] * repeat):
                plan.uses.append(Use(origin, first, many, start, n, nth, fill[n], plan.sequences, offset))
                nth += many
            offset += n * fill[n]
        if slack:
            nth = 0
            for origin, first, many, start in list(pool.take(giver, repeat)):
                plan.uses.append(Use(origin, first, many, start, slack, nth, 1, plan.sequences, offset))
                pool.give(giver - slack, origin, first, many, start + slack)
                nth += many
        plan.sequences += repeat
    _place_last(pool, plan)
    return plan


def _place_last(pool: Pool, plan: Plan) -> None:
    """Lay what is left, less than a window, end to end in sequences whose sizes are powers of two."""
    total = sum(n * c for n, c in pool.left.items())
    sizes = [1 << p for p in range(total.bit_length() - 1, -1, -1) if total >> p & 1]
    at = 0
    for n in sorted(pool.left, reverse=True):
        for origin, first, many, start in pool.take(n, pool.left[n]):
            for index in range(first, first + many):
                done = 0
                while done < n:
                    size = min(n - done, sizes[0] - at)
                    plan.uses.append(Use(origin, index, 1, start + done, size, 0, 1, plan.sequences, at))
                    done, at = done + size, at + size
                    if at == sizes[0]:
                        plan.sequences, at = plan.sequences + 1, 0
                        sizes.pop(0)


def placer(plan: Plan) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray]]:
    """A function that gives, for remainders of given length and index, (row, start within it, length, sequence,
    offset) of each piece."""
    uses = sorted(plan.uses, key=lambda u: (u.length, u.start, u.first))
    value = {name: np.array([getattr(u, name) for u in uses], np.int64) for name in Use.__dataclass_fields__}
    widest = int(value["length"].max(initial=0)) + 1
    groups, group = np.unique(value["length"] * widest + value["start"], return_inverse=True)
    keys = group << 40 | value["first"]

    def place(length: np.ndarray, index: np.ndarray) -> list[np.ndarray]:
        rows, start, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
        while len(rows):  # once for each piece of the remainder cut most often
            here = np.searchsorted(groups, length[rows] * widest + start)
            use = np.searchsorted(keys, here << 40 | index[rows], side="right") - 1
            size, per = value["size"][use], value["per"][use]
            nth = value["nth"][use] + index[rows] - value["first"][use]
            out.append([rows, start, size, value["sequence"][use] + nth // per, value["offset"][use] + nth % per * size])
            more = start + size < length[rows]
            rows, start = rows[more], (start + size)[more]
        return [np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(5)]

    return place


def tokenise(docs: DataFrame, path: str, window: int, id_col: str, text_col: str, closing: int) -> DataFrame:
    """One row for each full window and each remainder; `rest` has the ids of a remainder."""
    def rows(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest")}
        end = array("I", [closing]).tobytes()
        for doc, text in zip(part["doc_id"], part["text"], strict=True):
            ids = byte_tokens.load(path).ids(text) + end
            total = len(ids) // 4
            for start in range(0, total, window):
                piece = ids[4 * start:4 * (start + window)]
                length = len(piece) // 4
                for k, v in (("doc_id", doc), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(piece)),
                             ("doc_tokens", total), ("rest", piece if length < window else None)):
                    out[k].append(v)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, rest binary"
    return map_rows(source, rows, schema)


def pack(
    docs: DataFrame, path: str, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", closing: int = 0
) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    pieces = stable(
        tokenise(docs, path, window, id_col, text_col, closing).withColumn("uid", F.monotonically_increasing_id())
    )
    short = pieces.where(F.col("length") < window).drop("rest").withColumn("block", F.shiftright("uid", BLOCK))
    counts = stable(short.groupBy("length", "block").agg(F.count("*").alias("n")))
    plan = plan_windows({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, window)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("uid"))
    numbered = (
        short.withColumn("within", within).join(starts, ["length", "block"])
        .select("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens",
                (F.col("before") + F.col("within") - 1).alias("index"))
    )
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_items = placer(plan)
        for part in parts:
            if not part.num_rows:
                continue
            column = lambda name: part.column(name).to_numpy(zero_copy_only=False)
            length = column("length")
            row, start, size, sequence, offset = place_items(length, column("index"))
            whole = pa.array(size == length[row])
            crc = pa.compute.if_else(whole, part.column("ids_crc32").take(pa.array(row)), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "uid": part.column("uid").take(pa.array(row)), "doc_id": part.column("doc_id").take(pa.array(row)),
                "start": column("start")[row] + start, "length": size, "ids_crc32": crc,
                "doc_tokens": column("doc_tokens")[row], "sequence_id": sequence, "offset": offset, "skip": start,
            })

    schema = (
        f"uid long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, skip long"
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = numbered.mapInArrow(place, schema)
    full = pieces.where(F.col("length") == window).withColumns({
        "sequence_id": F.col("uid") + plan.sequences, "offset": F.lit(0).cast("long")
    })
    if not plan.cut():
        return full.select(names).unionAll(placed.select(names))
    placed = stable(placed)
    ids = F.expr("substring(rest, cast(4 * skip + 1 as int), cast(4 * length as int))")
    parts = (
        placed.where("ids_crc32 is null").drop("ids_crc32").join(pieces.select("uid", "rest"), "uid")
        .withColumn("ids_crc32", F.crc32(ids))
    )
    return (
        full.select(names).unionAll(placed.where("ids_crc32 is not null").select(names)).unionAll(parts.select(names))
    )
