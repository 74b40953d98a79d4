import hashlib
import random
import zlib

import pytest

from anchorline.llm import prefix_trie as P
from anchorline.llm.radix_tree import Direct, Indexed, Inner, Leaf, RadixTree, Sorted, common
from anchorline.llm.registry import rebuilt_paths


def plain(rows):
    """All nodes of the rebuilt conversations, by loops."""
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [r[2:] for r in sorted(x)] for c, x in said.items()}
    built = {}
    for conv, own in said.items():
        h = zlib.crc32(str(conv).encode()) % 6
        head = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        built[conv] = tuple(said.get(head, [])[:h] + own[h:])
    members = {}
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    out = set()
    for node, convs in members.items():
        under = [n for n in members if n[:len(node)] == node]
        childless = lambda n: not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)
        ended = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.add((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(n) == len(node) + 1 for n in under), sum(map(childless, under)),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n), hashlib.sha256(ended.encode()).hexdigest(),
        ))
    return out


def found(spark, rows, stretch):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, key int, id int")
    given = rebuilt_paths(df)
    none = hashlib.sha256(b"").hexdigest()
    nodes = P.trie(given, stretch).join(P.digest_of_ends(given), "node", "left").collect()
    out = [(r.first_id, r.depth, r.parent_first_id, r.n_members, r.n_children, r.n_leaves, r.saved, r.ends_sha256 or none)
           for r in nodes]
    assert len(set(out)) == len(out)
    return set(out)


@pytest.mark.parametrize(("seed", "stretch"), [(1, 2048), (2, 1), (3, 2), (4, 7)])
def test_nodes_equal_the_loops(spark, seed, stretch):
    rnd = random.Random(seed)
    texts = [None, "", "hi", "é😀", "long " * 400]
    rows = []
    for conv in [*rnd.sample(range(-250, 650), 120), 0, 100, 200]:
        for turn in range(rnd.randint(1, 7)):
            rows.append((conv, rnd.choice([turn, turn, turn, None, 3]), rnd.choice(["user", "user", None]), rnd.choice(texts[:3 + seed % 3])))
    rows += rnd.sample(rows, 10) + [(None, 0, "user", "x")]
    assert found(spark, rows, stretch) == plain(rows)


def test_many_copies_and_one_common_first_turn(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1200) for t in range(3)]
    rows += [(c, t, "user", "t0" if t == 0 else f"{c} {t}") for c in range(2000, 2400) for t in range(4)]
    assert found(spark, rows, 16) == plain(rows)


def test_turnless_conversations_and_empty_table(spark):
    rows = [(c, 0, "user", "x") for c in range(101, 130)]  # there is no conversation 100 to start with
    got = found(spark, rows, 4)
    assert got == plain(rows) and any(depth == 0 and n == 29 for _, depth, _, n, *_ in got)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.trie(rebuilt_paths(empty)).count() == 0


def test_one_long_conversation(spark):
    rows = [(7, t, "user", f"{t % 50}") for t in range(3000)]
    got = found(spark, rows, 2048)
    turns = 3000 if zlib.crc32(b"7") % 6 == 0 else 3000 - zlib.crc32(b"7") % 6
    assert len(got) == turns + 1 and all(n == 1 and leaves == 1 for _, _, _, n, _, leaves, *_ in got)


def keys_below(link):
    if isinstance(link, Leaf):
        return [link.key]
    own = [link.end.key] if link.end else []
    return own + [k for _, x in link.branches.items() for k in keys_below(x)]


def test_tree_keeps_keys_in_order_through_all_layouts():
    rnd = random.Random(5)
    for width in (1, 2, 3):
        keys = {bytes(rnd.choice([0, 1, 255, rnd.randrange(256)]) for _ in range(rnd.randint(0, width * 3))) for _ in range(1500)}
        tree, order = RadixTree(), list(keys)
        rnd.shuffle(order)
        for key in order:
            tree.insert(key, None)
        assert keys_below(tree.root) == sorted(keys)
        assert tree.root.least == min(keys)
    kinds, layout = [], Inner(b"", None)
    for n, byte in enumerate(rnd.sample(range(256), 256), 1):
        layout.put(byte, byte)
        kinds.append((n, type(layout.branches), getattr(layout.branches, "room", 0)))
        assert layout.branches.get(byte) == byte and [b for b, _ in layout.branches.items()] == sorted(b for b, _ in layout.branches.items())
    want = lambda n: (n, *((Sorted, 4) if n <= 4 else (Sorted, 16) if n <= 16 else (Indexed, 0) if n <= 48 else (Direct, 0)))
    assert kinds == [want(n) for n in range(1, 257)]


def test_common_start():
    for a, b, n in [(b"", b"x", 0), (b"abc", b"abd", 2), (b"abc", b"abc", 3), (b"\0\0a", b"\0\0", 2), (b"\1", b"\0", 0)]:
        assert common(a, b) == n
