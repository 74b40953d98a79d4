"""An adaptive radix tree over byte strings: what one task builds for one bounded, sorted stretch of keys.

Inner nodes skip the bytes that all their keys share (path compression), and a key alone below a branch is a leaf with
no inner node. A node's branches are kept in one of four layouts and move to the next one as they grow: sorted bytes for
up to 4 and up to 16, an index of 256 places for up to 48, and a slot for each byte beyond.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share at their start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Sorted:
    """Branches as sorted bytes beside their links."""

    def __init__(self, room: int, labels: bytes = b"", links: list | None = None):
        self.room, self.labels, self.links = room, bytearray(labels), list(links or ())

    def get(self, byte: int):
        at = bisect_left(self.labels, byte)
        return self.links[at] if at < len(self.labels) and self.labels[at] == byte else None

    def put(self, byte: int, link) -> bool:
        at = bisect_left(self.labels, byte)
        if at < len(self.labels) and self.labels[at] == byte:
            self.links[at] = link
        elif len(self.labels) == self.room:
            return False
        else:
            self.labels.insert(at, byte)
            self.links.insert(at, link)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return zip(self.labels, self.links, strict=True)

    def larger(self) -> Sorted | Indexed:
        if self.room == 4:
            return Sorted(16, self.labels, self.links)
        return Indexed(self.labels, self.links)


class Indexed:
    """Branches in order of arrival, with the place of each byte."""

    def __init__(self, labels: bytes, links: list):
        self.places, self.links = bytearray(256), list(links)
        for place, byte in enumerate(labels, 1):
            self.places[byte] = place

    def get(self, byte: int):
        place = self.places[byte]
        return self.links[place - 1] if place else None

    def put(self, byte: int, link) -> bool:
        place = self.places[byte]
        if place:
            self.links[place - 1] = link
        elif len(self.links) == 48:
            return False
        else:
            self.links.append(link)
            self.places[byte] = len(self.links)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((byte, self.links[place - 1]) for byte, place in enumerate(self.places) if place)

    def larger(self) -> Direct:
        return Direct(self)


class Direct:
    """A slot for each byte."""

    def __init__(self, before: Indexed):
        self.links = [before.get(byte) for byte in range(256)]

    def get(self, byte: int):
        return self.links[byte]

    def put(self, byte: int, link) -> bool:
        self.links[byte] = link
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((byte, link) for byte, link in enumerate(self.links) if link is not None)


class Leaf:
    """A key that nothing else continues, and its value."""

    __slots__ = ("key", "value")

    def __init__(self, key: bytes, value):
        self.key, self.value = key, value


class Inner:
    """Keys that share `skip` after the byte that leads here; `least` is the smallest of them, `end` the leaf of the key
    that ends here, if one does."""

    __slots__ = ("skip", "branches", "end", "least")

    def __init__(self, skip: bytes, least: bytes | None):
        self.skip, self.branches, self.end, self.least = skip, Sorted(4), None, least

    def put(self, byte: int, link) -> None:
        if not self.branches.put(byte, link):
            self.branches = self.branches.larger()
            self.branches.put(byte, link)

    def add(self, leaf: Leaf, depth: int) -> None:
        """Hang a key that shares the first `depth` bytes and has no branch here yet."""
        if len(leaf.key) == depth:
            self.end = leaf
        else:
            self.put(leaf.key[depth], leaf)


class RadixTree:
    def __init__(self):
        self.root = Inner(b"", None)

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not in the tree."""
        leaf, depth, node, hangs = Leaf(key, value), 0, self.root, None
        while True:
            shared = common(node.skip, key[depth:depth + len(node.skip)])
            if shared < len(node.skip):  # the path parts within what the node skips
                upper = Inner(node.skip[:shared], min(node.least, key))
                upper.put(node.skip[shared], node)
                node.skip = node.skip[shared + 1:]
                upper.add(leaf, depth + shared)
                hangs[0].put(hangs[1], upper)
                return
            node.least = key if node.least is None else min(node.least, key)
            depth += len(node.skip)
            below = None if depth == len(key) else node.branches.get(key[depth])
            if below is None:
                node.add(leaf, depth)
                return
            if isinstance(below, Leaf):
                shared = common(below.key[depth + 1:], key[depth + 1:])
                inner = Inner(key[depth + 1:depth + 1 + shared], min(below.key, key))
                inner.add(below, depth + 1 + shared)
                inner.add(leaf, depth + 1 + shared)
                node.put(key[depth], inner)
                return
            hangs, node, depth = (node, key[depth]), below, depth + 1
