"""What the driver keeps while the blocks of a long run are matched at once: a few numbers per block.

Treated units choose in descending score. Two facts keep the border between two blocks small, at the time when all units
above it have chosen:

* Controls below it that are taken are the highest ones, without a gap. Their number is enough.
* Of the free controls above it, the lowest ones go first. So the free controls that a block leaves behind are a list
  whose low end is used up, and a number for each list is enough.

So each block is matched on a guess of its upper border. A guess first comes from the same rule on a coarse line of
slices, then from what the blocks above have left, together with the known total of all choices. Whoever was matched
on the border that the blocks above in fact leave is done, all others go into the next round. A block's first
choices mostly make up for a wrong guess of how the choices above it fell on the two sides, so that what it leaves is
right already. Each round settles one more block at least.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate
from math import inf
from typing import NamedTuple


class Left(NamedTuple):
    """Free controls that a block leaves behind: solved by task `key`; `gone` of them are used up. `marks` are checksums of
    the lowest 1, 2, 4 ... of them and of all."""

    block: int
    key: int
    marks: tuple[int, ...]
    gone: int
    free: int

    def same(self, other: Left, taken: int) -> bool:
        """Whether a task that took some controls of one list would have found the same in the other."""
        if (self.block, self.gone) != (other.block, other.gone):
            return False
        whole = self.free == other.free and self.marks[-1] == other.marks[-1]
        if whole or taken == self.free:
            return whole
        level = (self.gone + taken).bit_length()  # the lowest controls up to the first one that it left, or more
        return level < min(len(self.marks), len(other.marks)) - 1 and self.marks[level] == other.marks[level]


Stack = tuple[Left, "Stack"] | None


def popped(stack: Stack, units: int) -> Stack:
    """The lists left after the lowest `units` controls are gone."""
    while stack and units:
        top, below = stack
        if units < top.free:
            return top._replace(gone=top.gone + units, free=top.free - units), below
        stack, units = below, units - top.free
    return stack


def top_of(stack: Stack, least: int, units: int) -> tuple[tuple[Left, ...], bool]:
    """The nearest lists, `least` of them and as many as hold `units` controls, and whether there are more."""
    out: list[Left] = []
    while stack and (len(out) < least or units > 0):
        out.append(stack[0])
        units -= stack[0].free
        stack = stack[1]
    return tuple(out), stack is not None


@dataclass(frozen=True)
class Given:
    """What a block is matched on: its own cells from the line (`own` None, `skip` of them taken) or as task `own` has left
    them, the number of controls taken below the block, and the nearest free lists above."""

    own: int | None
    skip: int
    below: int
    above: tuple[Left, ...]
    more: bool


@dataclass
class Solved:
    """A task's result: what it took of each list above, what is taken below the block, and what it leaves."""

    key: int
    given: Given
    pops: list[int]
    below: int
    marks: tuple[int, ...]
    free: int
    stopped: bool
    fail_above: bool
    fail_below: bool

    def holds_for(self, given: Given) -> bool:
        """Whether the task would have done the same on `given`: all that it has looked at is equal."""
        mine, other = self.given, given
        if (mine.own, mine.skip, mine.below) != (other.own, other.skip, other.below):
            return False
        seen = len(mine.above) if self.stopped else sum(n > 0 for n in self.pops) + 1
        if self.stopped and (mine.more, len(mine.above)) != (other.more, len(other.above)):
            return False  # it may have stopped for want of a list above
        a, b = mine.above[:seen], other.above[:seen]
        return len(a) == len(b) and all(map(Left.same, a, b, self.pops))


class Slice(NamedTuple):
    block: int
    score: float
    treated: int
    controls: int


def coarse(slices: Sequence[Slice]) -> dict[int, int]:
    """Controls taken below each block, if each slice of the line were one score."""
    left = [s.controls for s in slices]
    above: list[int] = []  # slices with free controls above, the nearest one last
    first, taken, out = 0, 0, {}
    for i, here in enumerate(slices):
        taken -= here.controls - left[i]
        due = here.treated
        own = min(due, left[i])
        left[i] -= own
        due -= own
        while due:
            while first < len(slices) and (first <= i or not left[first]):
                first += 1
            while above and not left[above[-1]]:
                above.pop()
            to_above = slices[above[-1]].score - here.score if above else inf
            to_below = here.score - slices[first].score if first < len(slices) else inf
            if to_above == to_below == inf:
                break
            chosen = above[-1] if to_above <= to_below else first
            took = min(due, left[chosen])
            left[chosen] -= took
            due -= took
            taken += took if chosen > i else 0
        if left[i]:
            above.append(i)
        out[here.block] = taken
    return out


@dataclass
class Chain:
    """The blocks of one run from the high scores to the low, and their latest results."""

    blocks: range
    controls: Sequence[int]
    treated: Sequence[int]
    guess: dict[int, int]
    reach: int
    block_cells: int
    results: dict[int, list[Solved]] = field(default_factory=dict)
    last_seen: dict[int, Solved] = field(default_factory=dict)
    known: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    rounds: int = 0

    def __post_init__(self):
        self.upto = [0, *accumulate(self.controls[b] for b in self.blocks)]

    def wanted(self, block: int) -> int:
        """Controls that a task has at hand on each side: all that its block can take, within a bound."""
        return min(self.treated[block], self.reach * self.block_cells)

    def lower(self, block: int, taken: int) -> tuple[list[tuple[int, int]], bool]:
        """The nearest blocks below with free controls, how many of each are taken, and whether there are more."""
        start = self.blocks.start
        gone = self.upto[block + 1 - start] + taken
        at, out, units = bisect_right(self.upto, gone) - 1, [], self.wanted(block)
        while at < len(self.blocks) and (len(out) < self.reach or units > 0):
            if self.upto[at + 1] > gone:
                out.append((start + at, max(0, gone - self.upto[at])))
                units -= self.upto[at + 1] - max(gone, self.upto[at])
            at += 1
        return out, self.upto[-1] > max(gone, self.upto[at])

    def due(self) -> Iterator[tuple[int, Given]]:
        """The blocks to be matched in the next round, and on what; none when all hold."""
        below, stack, free, total = 0, None, 0, 0
        for b in self.blocks:
            own, skip = None, min(below, self.controls[b])
            rest = below - skip
            total += self.controls[b] - self.treated[b]
            steps = self.results.setdefault(b, [])
            begun, open_ = free, None
            for at in range(len(steps) + 1):
                given = Given(own, skip, rest, *top_of(stack, self.reach, self.wanted(b)))
                if at == len(steps) or not steps[at].holds_for(given):
                    del steps[at:]
                    open_ = given
                    break
                one = steps[at]
                stack, free, rest = popped(stack, sum(one.pops)), free - sum(one.pops), one.below
                if not one.stopped:
                    break
                own, skip = one.key, 0
            if open_ is not None:
                yield b, open_
                old = self.last_seen.get(b)
                rest = self.expected(b, below)
                made = 0 if old is None else old.free
                gone = min(max(free + made - max(total + rest, 0), 0), free)
                stack, free = popped(stack, gone), free - gone
            else:
                old = steps[-1]
            if old is not None and old.free:
                stack, free = (Left(b, old.key, old.marks, 0, old.free), stack), free + old.free
            below = rest
        self.rounds += 1

    def expected(self, block: int, taken: int) -> int:
        """Controls taken below a block if `taken` are below its upper border: by the coarse line at first, then by what came
        out last. A block that took nothing from above passes a change on; others make up for it on that side."""
        known = self.known.get(block)
        if known is None or self.rounds < 2:
            return self.guess[block]
        put, got, passes = known
        return max(got + taken - put, 0) if passes else got

    def take(self, block: int, result: Solved) -> None:
        steps = self.results[block]
        steps.append(result)
        self.last_seen[block] = result
        if not result.stopped:
            passes = result.below > 0 and not any(sum(x.pops) for x in steps)
            self.known[block] = steps[0].given.skip + steps[0].given.below, result.below, passes

    def final(self) -> list[Solved]:
        return [one for b in self.blocks for one in self.results[b]]
