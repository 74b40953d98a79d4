import random
import re
from collections import defaultdict

import numpy as np
import pytest

from anchorline.llm import mixing as M
from anchorline.llm.registry import QUERIES
from tests.llm.plain import FOLDER, documents


def wanted(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by stopping one source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


def check(rows, got):
    """`rows`: (id, source, text); `got`: rows of the mix."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, source, text in rows:
        sizes[source] += size(text)
    target = wanted(dict(sizes))
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted(((r.id, r.source, r.size) for r in got), key=key) == sorted(((i, s, size(t)) for i, s, t in rows), key=key)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size + r.cut and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
        assert sum(r.cut > 0 for r in got if r.source == s) <= 1
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert all(int(rate + 1e-9) <= r.copies <= -int(-rate // 1) for r in got if r.source == s and r.size and not r.cut)


def made_up(seed):
    rnd = random.Random(seed)
    rows = []
    for source, n in [("a", 400), ("b", 150), (None, 60), ("", 5), ("é", 300), ("z", 1), ("none", 3)]:
        for i in range(n):
            words = 0 if source == "none" else int(rnd.paretovariate(0.9))
            rows.append((rnd.choice([None, i, i, i]), source, rnd.choice([" ", "\n", "  "]).join(["w"] * min(words, 20_000)) if words or rnd.random() < 0.5 else None))
    return rows + rows[:40]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 16)])
def test_words_meet_targets(spark, seed, block):
    rows = made_up(seed)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, source string, text string, size int, item string")
    got = M.mix(df, block=block).collect()
    check(rows, got)
    again = M.mix(df.repartition(7), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_rows_alike(spark):
    rows = [(None, "s", "one two three")] * 500 + [(7, "s", "")] * 20 + [(1, "t", "w " * 4000)]
    check(rows, M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=3).collect())


def test_chances_stay_right_on_average_and_words_do_not_move():
    words = np.array([3.0, 50, 7, 7, 1, 900, 20, 4])
    chance = np.array([0.5, 0.3, 0.9, 0.1, 0.5, 0.25, 0.6, 0.05])
    total = np.zeros(len(words))
    for seed in range(6000):
        settled, open_ = M.pivot(words, chance, np.random.default_rng(seed))
        assert settled @ words == pytest.approx(chance @ words)
        assert all(x in (0, 1) for i, x in enumerate(settled) if i != open_)
        total += settled
    assert np.abs(total / 6000 - chance).max() < 0.03


def test_sources_of_no_words_and_empty_table(spark):
    rows = [(1, "a", None), (2, "b", "  "), (None, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix(df).collect()
    assert sorted((r.size, r.source_size, r.target, r.taken) for r in got) == [(0, 0, 0.0, 0)] * 3
    assert M.mix(df.limit(0)).count() == 0


def test_query(spark):
    got = QUERIES["op11_mixing"](spark, FOLDER).withColumnRenamed("doc_id", "id").collect()
    docs = {r.doc_id: r for r in documents(spark).collect()}
    rows = [(r.doc_id, r.source, r.text) for r in documents(spark).collect()]
    source = {r.doc_id: r.source for r in docs.values()}
    check(rows, [type("Row", (), r.asDict() | {"source": source[r.id]})() for r in got])
