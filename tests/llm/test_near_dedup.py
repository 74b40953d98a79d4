import random
import re

import numpy as np

from anchorline.llm import near_dedup as N
from anchorline.llm.graph import components
from anchorline.llm.registry import QUERIES
from tests.llm.plain import FOLDER, documents


def runs(text):
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return []
    seen, out = {}, []
    for i in range(max(1, len(words) - 4)):
        run = tuple(words[i:i + 5])
        seen[run] = seen.get(run, -1) + 1
        out.append((run, seen[run]))
    return out


def similarity(a, b):
    """By the full table of the longest common subsequence."""
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i, j] = best[i - 1, j - 1] + 1 if x == y else max(best[i - 1, j], best[i, j - 1])
    n = best[-1, -1]
    return n / (len(a) + len(b) - n) if n else 0.0


def classes(docs, least=0.8):
    seqs = [(i, runs(t), t) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a, _) in enumerate(seqs):
        for j, b, _ in seqs[:k]:
            if a and b and len(set(a) & set(b)) >= least * max(len(a), len(b)) * 0.9 and similarity(a, b) >= least:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def made_up(seed=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        for edits in (0, 0, 1, 2, 3, 8):
            text = list(base)
            for _ in range(edits):
                at = rnd.randrange(len(text))
                text[at:at + 1] = rnd.choice([[], [rnd.choice(words)], [text[at], rnd.choice(words)]])
            docs.append(" ".join(text))
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_classes_equal_all_pairs(spark):
    docs = made_up()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = N.near_duplicates(df).collect()
    assert {r.id: r.class_id for r in got} == classes(docs)
    assert {r.id for r in got if r.kept} == set(classes(docs).values())


def test_a_group_of_many_near_copies_is_one_class(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    docs = [(0, " ".join(base))]
    for i in range(1, 400):
        text = list(base)
        for _ in range(rnd.randint(1, 3)):
            text[rnd.randrange(200)] = f"x{rnd.random()}"
        docs.append((i, " ".join(text)))
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_copies_of_copies_join_the_class_of_a_member_that_is_not_its_centre(spark):
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(200)]

    def edited(text, edits):
        text = list(text)
        for at in rnd.sample(range(0, 200, 5), edits):
            text[at] = f"x{rnd.random()}"
        return text

    copies = [base] + [edited(base, rnd.randint(1, 3)) for _ in range(300)]
    copies += [edited(rnd.choice(copies[1:]), 4) for _ in range(60)]
    docs = [(i, " ".join(text)) for i, text in enumerate(copies)]
    sets = [set(runs(text)) for _, text in docs]  # words of a text differ and stay in place: shared runs are aligned
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.id: r.class_id for r in got} == {i: find(i) for i, _ in docs}


def test_no_pair_of_short_texts_is_missed(spark):
    docs, footer = [], " all rights are reserved by the owner"
    for n in range(8, 45):
        for k, change in enumerate(("append", "drop first", "prepend", "last", "same start")):
            words = [f"t{n}x{k}y{i}" for i in range(n)]
            other = {
                "append": [*words, "more"], "drop first": words[1:], "prepend": ["more", *words],
                "last": [*words[:-1], "more"], "same start": [*words[:-2], f"a{n}", f"b{n}"],
            }[change]
            docs += [" ".join(words) + footer * (n % 3 == 0), " ".join(other) + footer * (n % 3 == 0)]
    docs = list(enumerate(docs))
    want = {}
    for (i, a), (j, b) in zip(docs[::2], docs[1::2], strict=True):
        want |= {i: i, j: i if similarity(runs(a), runs(b)) >= 0.8 else j}
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.id: r.class_id for r in got} == want


def test_alignment_equals_the_full_table():
    rnd = random.Random(5)
    for _ in range(60):
        a = rnd.sample(range(60), rnd.randint(5, 40))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(b))
            b[at:at + 1] = rnd.choice([[], [100 + rnd.randrange(50)], [b[at], 200 + rnd.randrange(50)]])
        b = list(dict.fromkeys(b))
        if rnd.random() < 0.3:
            at = rnd.randrange(len(b))
            b = b[at:] + b[:at]
        want = similarity(a, b)
        got = N.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert got == (want if want >= 0.8 else 0.0)


def test_sketches_notice_order():
    a = N.labelled_runs(" ".join(f"w{i}" for i in range(40)))
    assert (N.sketches(a, 8, 6) == N.sketches(a.copy(), 8, 6)).all()
    assert (N.sketches(a, 8, 6) != N.sketches(a[::-1].copy(), 8, 6)).all()


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [
        (1, None, 0), (2, "", 0), (3, " !? ", 0), (4, "two words", 0), (5, "Two  words.", 0), (6, long, 0), (6, long, 0),
        (None, long, 0), (7, long + " more", 0), (8, "w " * 30_000, 0), (9, "w " * 29_999, 0), (6, "other text", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = N.near_duplicates(df).collect()
    assert sum(r.repeats for r in got) == len(rows)
    kept = sorted(((r.id, r.class_id, r.repeats) for r in got if r.kept))
    assert kept == [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (6, 6, 1), (6, 6, 2), (8, 8, 1)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = QUERIES["op1_near_dedup"](spark, FOLDER).collect()
    shorter = [(i, t) for i, t in docs if len(t) < 1500]
    want = classes(shorter)
    found = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(docs) and sum(r.kept for r in got) == len(set(found.values()))
    for i, root in want.items():
        assert found[i] == found[root]


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(40), rnd.randrange(40)) for _ in range(25)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs + [(None, 1)], "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in p for p in pairs if p[0] != p[1])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
