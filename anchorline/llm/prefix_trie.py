"""Prefix trie of conversations, from adaptive radix trees over fixed-width turn ids.

A turn (role and text) has an id of 16 bytes, read as a big-endian number: the start of the SHA-256 of both. A
conversation's key is its turn ids in order. Equal keys are reduced to one row, distinct keys are range-partitioned and
sorted, and each task builds radix trees over bounded stretches of them. A walk over a tree emits a node at each depth
that is a whole number of turns, also where the tree skips it by path compression, and none at other depths.

Stretches share the nodes along the path on which they meet. A tree therefore knows the last key before its own, and
counts only what is new: members and their texts count everywhere, a node itself, as a child or as a leaf, in the first
stretch that has it. All figures of a node, those of its subtree included, are then sums over the stretches, and one
aggregate gives them. So a first turn that a third of all conversations share is spread over many tasks.

A conversation's key is one row: 20 bytes for each of its turns, not their texts. Turns follow each other by turn
number (null first), then role, then text; repeated rows are turns of their own. Null roles and texts are empty.
Rows whose conversation id is null belong to no conversation. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.llm.common import text_of
from anchorline.llm.radix_tree import Inner, Leaf, RadixTree, common
from anchorline.session import stable

WIDTH = 16
#: A stretch ends with this many keys, or bytes of keys; this changes no result.
KEYS, BYTES = 2048, 8 << 20


def node_id(key: Column) -> Column:
    """The number of the trie's node that a key leads to."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 2 * WIDTH))


def paths(
    messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, key, sizes): the turn ids of each conversation in order, and the code points of their texts."""
    role, text = text_of(role_col), text_of(text_col)
    said = messages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        node_id(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")).alias("name"),
        F.length(text).alias("size"),
    )
    rows = (
        said.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")
        .select("id", "name", "size")
    )
    kind = said.schema["id"].dataType.simpleString()
    fields = F.array().cast("array<int>")

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, sizes = None, bytearray(), []
        for part in parts:
            done: tuple[list, list, list] = ([], [], [])
            for ident, name, size in zip(*(part[c].to_pylist() for c in ("id", "name", "size")), strict=True):
                if ident != now:
                    if key:
                        done[0].append(now), done[1].append(bytes(key)), done[2].append(sizes)
                    now, key, sizes = ident, bytearray(), []
                key += name
                sizes.append(size)
            if done[0]:
                yield made(*done, part.schema.field("id").type)
            last = part.schema.field("id").type
        if key:
            yield made([now], [bytes(key)], [sizes], last)

    def made(ids: list, keys: list, sizes: list, type_of_id: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "id": pa.array(ids, type_of_id), "key": pa.array(keys, pa.binary()),
            "sizes": pa.array(sizes, pa.list_(pa.int32())),
        })

    return rows.mapInArrow(joined, f"id {kind}, key binary, sizes array<int>").withColumn(
        "sizes", F.coalesce("sizes", fields)
    )


def started_with(own: DataFrame, head_of: Column, turns: Column, most: int) -> DataFrame:
    """`own` paths, whose first `turns` (a column over `id`, `most` at most) are replaced by as many first turns of the
    path with the id `head_of`: all of them if it has fewer, none if there is no such path."""
    heads = own.select(
        F.col("id").alias("__head"), F.substring("key", 1, WIDTH * most).alias("__key"),
        F.slice("sizes", 1, most).alias("__sizes"),
    )
    plan = own.withColumns({"__of": head_of, "__n": turns.cast("int")})
    n = F.col("__n")
    key = F.concat(
        F.coalesce(F.substr("__key", F.lit(1), n * WIDTH), F.lit(b"")), F.substr("key", n * WIDTH + 1)
    )
    sizes = F.concat(
        F.coalesce(F.slice("__sizes", F.lit(1), n), F.array().cast("array<int>")),
        F.slice("sizes", n + 1, F.greatest(F.size("sizes") - n, F.lit(0))),
    )
    return plan.join(heads, plan["__of"] == heads["__head"], "left").select("id", key.alias("key"), sizes.alias("sizes"))


class _Sums:
    """What a subtree adds to the figures of the nodes above it."""

    __slots__ = ("n", "first", "children", "leaves", "all", "once")

    def __init__(self):
        self.n, self.first, self.children, self.leaves, self.all, self.once = 0, None, 0, 0, 0, 0

    def add(self, other: _Sums) -> None:
        self.n += other.n
        self.first = other.first if self.first is None else min(self.first, other.first)
        self.children += other.children
        self.leaves += other.leaves
        self.all += other.all
        self.once += other.once


def emit(tree: RadixTree, before: bytes | None) -> Iterator[tuple]:
    """The turn-aligned nodes of a tree whose values are (members, smallest member, sizes, ...), children first:
    (node, parent, depth, first_id, n_members, n_children, n_leaves, saved). `before` is the last key ahead of the
    tree's; nodes on its path have been counted with it, as nodes."""
    smallest = tree.root.least
    met = -1 if before is None else common(before, smallest)
    ended = before is not None and met == len(before)  # the last key counted as a leaf, and is none

    def opened(link: Inner | Leaf, depth: int, hashed) -> list:
        """A frame: a key through the link, the depth of its branches, digests of the aligned depths on the way there, the
        hash at the last of them, sums, links to visit, and the link."""
        key = link.key if isinstance(link, Leaf) else link.least
        bottom = len(key) if isinstance(link, Leaf) else depth + len(link.skip)
        digests = []
        if depth == 0:
            digests.append((0, hashed.digest()[:WIDTH]))
        for at in range((max(depth, 1) + WIDTH - 1) // WIDTH * WIDTH, bottom + 1, WIDTH):
            hashed = hashed.copy()
            hashed.update(key[at - WIDTH:at])
            digests.append((at, hashed.digest()[:WIDTH]))
        sums, below = _Sums(), iter(())
        ends = link if isinstance(link, Leaf) else link.end
        if ends is not None:
            sums.n, sums.first = ends.value[0], ends.value[1]
        if isinstance(link, Inner):
            below = iter([x for _, x in link.branches.items()])
            sums.leaves = int(not link.branches.links)  # a root that holds the empty key alone
        else:
            sums.leaves = 1
        return [key, bottom, digests, hashed, sums, below, link]

    def sizes_of(link: Inner | Leaf) -> list[int]:
        while not isinstance(link, Leaf):
            link = link.end or next(x for _, x in link.branches.items())
        return link.value[2]

    stack = [opened(tree.root, 0, hashlib.sha256())]
    over: list[bytes] = []  # digests of the aligned nodes from the root to the top frame
    over += [d for _, d in stack[0][2]]
    while stack:
        key, bottom, digests, hashed, sums, below, link = stack[-1]
        nxt = next(below, None)
        if nxt is not None:
            frame = opened(nxt, bottom + 1, hashed)
            stack.append(frame)
            over += [d for _, d in frame[2]]
            continue
        stack.pop()
        sizes = sizes_of(link) if digests else []
        for at, digest in reversed(digests):
            over.pop()
            shared = at <= met and key is smallest
            if shared and ended and at == len(before):
                sums.leaves -= 1
            size = sizes[at // WIDTH - 1] if at else 0
            sums.all += sums.n * size
            sums.once += 0 if shared else size
            yield (digest, over[-1] if over else None, at // WIDTH, sums.first, sums.n, sums.children, sums.leaves,
                   sums.all - sums.once)
            sums.children = 0 if shared else 1
        if stack:
            stack[-1][4].add(sums)


def trie(given: DataFrame, stretch: int = KEYS) -> DataFrame:
    """The nodes of all `given` paths (id, key, sizes), the root included: (node, parent, depth, first_id,
    parent_first_id, n_members, n_children, n_leaves, saved). `first_id` is the smallest id whose path starts with the
    node's turns; `saved` sums, over the node and all below it, the size of a node's last turn for each member but
    one. A tree holds `stretch` keys at most."""
    distinct = given.groupBy(node_id(F.col("key")).alias("node")).agg(
        F.first("key").alias("key"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("id").alias("first_id")
    ).drop("node")
    ordered = stable(
        distinct.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    )
    tails = ordered.groupBy("part").agg(F.max("key").alias("key"))  # one row for each partition
    before = tails.select("part", F.lag("key").over(Window.orderBy("part")).alias("key")).where("key is not null")
    kind = given.schema["id"].dataType.simpleString()
    rows = (
        ordered.unionByName(before, allowMissingColumns=True)
        .repartition("part").sortWithinPartitions("part", "key").select("part", "key", "sizes", "n", "first_id")
    )

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_now, before, last, tree, keys, room = None, None, None, RadixTree(), 0, 0
        for batch in parts:
            kinds = batch.schema.field("first_id").type
            columns = (batch[c].to_pylist() for c in ("part", "key", "sizes", "n", "first_id"))
            for part, key, sizes, n, first in zip(*columns, strict=True):
                if keys and (part != part_now or keys == stretch or room > BYTES):
                    yield told(tree, before, kinds)
                    before, tree, keys, room = last, RadixTree(), 0, 0
                if part != part_now:
                    part_now, before = part, None
                if n is None:  # the last key of the partition ahead
                    before = key
                    continue
                tree.insert(key, (n, first, sizes))
                last, keys, room = key, keys + 1, room + len(key)
        if keys:
            yield told(tree, before, kinds)

    def told(tree: RadixTree, before: bytes | None, kinds: pa.DataType) -> pa.RecordBatch:
        types = [pa.binary(), pa.binary(), pa.int64(), kinds, *[pa.int64()] * 4]
        names = ["node", "parent", "depth", "first_id", "n_members", "n_children", "n_leaves", "saved"]
        columns = zip(*emit(tree, before), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    parts = rows.mapInArrow(
        build, f"node binary, parent binary, depth long, first_id {kind}, n_members long, n_children long, n_leaves long, "
        "saved long",
    )
    nodes = stable(
        parts.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("first_id").alias("first_id"),
            *(F.sum(c).alias(c) for c in ("n_members", "n_children", "n_leaves", "saved")),
        )
    )
    above = nodes.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("first_id").alias("parent_first_id")
    )
    return nodes.join(above, "parent", "left").select(
        "node", "parent", "depth", "first_id", "parent_first_id", "n_members", "n_children", "n_leaves", "saved"
    )


def ends(given: DataFrame) -> DataFrame:
    """(node, id): the node at which each path ends."""
    return given.select(node_id(F.col("key")).alias("node"), "id")


def digest_of_ends(given: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids that end at each node, ascending and joined by commas. The ids of a node
    stream through the hash in order; they are never held together."""
    rows = ends(given).repartition("node").sortWithinPartitions("node", "id").select(
        "node", F.col("id").cast("string").alias("id")
    )

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        for part in parts:
            out: tuple[list, list] = ([], [])
            for node, ident in zip(part["node"].to_pylist(), part["id"].to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        out[0].append(now), out[1].append(hashed.hexdigest())
                    now, hashed = node, hashlib.sha256(ident.encode())
                else:
                    hashed.update(b"," + ident.encode())
            if out[0]:
                yield pa.RecordBatch.from_pydict({"node": pa.array(out[0], pa.binary()), "ends_sha256": out[1]})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([now], pa.binary()), "ends_sha256": [hashed.hexdigest()]})

    return rows.mapInArrow(digests, "node binary, ends_sha256 string")
