import hashlib
import random

import pytest

from anchorline.llm import line_dedup as L
from anchorline.llm.registry import QUERIES
from tests.llm.plain import FOLDER, documents


def lines_of(text):
    return [x.strip() for x in (text or "").split("\n") if x.strip()]


def lines_left(docs, least):
    """For each document the lines that are in no run of enough words that occurs at an earlier place."""
    seen, out = [], {}
    for doc, text in docs:
        mine = lines_of(text)
        seen.append(mine)
        hit = [False] * len(mine)
        for m, other in enumerate(seen):
            for a in range(len(mine)):
                for b in range(len(other)):
                    if m == len(seen) - 1 and b >= a:
                        continue
                    k = 0
                    while a + k < len(mine) and b + k < len(other) and mine[a + k] == other[b + k]:
                        k += 1
                    if sum(len(x.split()) for x in mine[a:a + k]) >= least:
                        hit[a:a + k] = [True] * k
        out[doc] = [x for x, h in zip(mine, hit, strict=True) if not h]
    return out


def made_up(seed, short):
    rnd = random.Random(seed)
    sizes = [2, 4, 6] if short else [10, 12, 15]
    line = lambda: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.choice(sizes)))
    pool = [line() for _ in range(25)]
    docs = []
    for i in range(30):
        own = [f"{line()} u{rnd.random()}" for _ in range(rnd.randint(0, 3))]
        if short:  # passages of several short lines, each line in one passage only
            shared = [x for k in rnd.sample(range(5), 2) for x in pool[5 * k:5 * k + 5]]
        else:
            shared = [rnd.choice(pool) for _ in range(rnd.randint(0, 5))]
        parts = own + shared
        docs.append((i, rnd.choice(["\n", "\n\n", " \n"]).join(parts) if rnd.random() < 0.9 else None))
    return docs


@pytest.mark.parametrize(("seed", "short"), [(1, False), (2, False), (3, True), (4, True)])
def test_equals_all_comparisons(spark, seed, short):
    docs = made_up(seed, short)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: lines_of(r.text) for r in L.drop_repeated_lines(df).collect()}
    assert got == lines_left(docs, 10)


@pytest.mark.parametrize("common", [12, 15])
def test_runs_of_lines_that_different_runs_share(spark, common):
    rnd = random.Random(common)
    pool = [" ".join(f"m{i}" for _ in range(rnd.randint(1, 3))) for i in range(common)]
    menus = [[rnd.choice(pool) for _ in range(rnd.randint(8, 10))] for _ in range(20)]
    docs = [(i, "\n".join([f"own line {i}", *rnd.choice(menus), f"end of {i}"])) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: lines_of(r.text) for r in L.drop_repeated_lines(df).collect()}
    assert got == lines_left(docs, 10)


def test_every_long_enough_run_shares_a_fingerprint():
    rnd = random.Random(7)
    for _ in range(100):
        words = [rnd.randint(1, 6) for _ in range(20)]
        run = [rnd.getrandbits(60) for _ in words]
        before, after = ([rnd.getrandbits(60) for _ in range(rnd.randint(0, 9))] for _ in range(2))
        sizes = [rnd.randint(1, 6) for _ in before], [rnd.randint(1, 6) for _ in after]
        there = {run[i] for i in L.fingerprints(run, words, 10)}
        whole = before + run + after
        assert there <= {whole[i] for i in L.fingerprints(whole, sizes[0] + words + sizes[1], 10)}


def test_edge_cases(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [
        (1, None, "x"), (2, "", "x"), (3, long, "x"), (4, long, "x"), (4, long, "x"), (None, long, "x"),
        (5, f"a\n\n{long}\n\n{long}\nb", "x"), (6, "\n \n", "x"), (7, "short line\nshort line", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, left string")
    done = L.drop_repeated_lines(df)
    assert done.columns == ["doc_id", "text", "deleted", "left"]
    assert sorted((r.doc_id or 99, r.text, r.deleted) for r in done.collect()) == [
        (1, None, 0), (2, "", 0), (3, long, 0), (4, "", 1), (4, "", 1), (5, "a\n\n\nb", 2), (6, "\n \n", 0),
        (7, "short line\nshort line", 0), (99, "", 1),
    ]
    assert L.drop_repeated_lines(df.limit(0)).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    want = lines_left(docs[:60], 10)
    df = spark.createDataFrame(docs[:60], "doc_id long, text string")
    done = L.drop_repeated_lines(df).collect()
    for r in done:
        assert len(lines_of(r.text)) >= len(want[r.doc_id])  # nothing is deleted that is not repeated
    assert sum(len(lines_of(r.text)) for r in done) <= 1.02 * sum(map(len, want.values()))
    got = QUERIES["op5_line_dedup"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    same = {r.doc_id: r.text_sha256 for r in got if not r.n_deleted}
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == same[d] for d, t in docs if d in same)


def test_extension_and_what_is_left_to_the_second_join():
    lines = ["a b c d", "e f g h", "i j k l", "m n o p", "q r s t"]
    found = {at: rest for at, *rest in L.text_fingerprints("\n".join(lines), 10)}
    _, hashes, words = L.line_hashes("\n".join(lines))
    assert set(found) == set(L.fingerprints(hashes, words, 10)) | {
        4 - at for at in L.fingerprints(hashes[::-1], words[::-1], 10)
    }
    for at, (own, before, after, windows) in found.items():
        assert own == hashes[at]
        held, rest = L.extended(before, after, before, after, windows)
        assert rest == [] and held == (len(before) // L.SIZE, len(after) // L.SIZE)
        held, rest = L.extended(before, after, b"", b"", windows)
        assert held is None and rest == windows  # each window has three lines
    assert sum(len(w) for *_, w in found.values()) == 3
    assert L.in_common(b"", b"x" * L.SIZE) == 0


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_few_short_lines_in_any_order(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate([1, 1, 2, 3, 5, 11])]
    docs = [
        (None if i == 0 else i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) or None) for i in range(25)
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: lines_of(r.text) for r in L.drop_repeated_lines(df).collect()}
    assert got == lines_left([*docs[1:], docs[0]], 10)  # a null id comes last
