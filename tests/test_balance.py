import random
import statistics

import pytest

from anchorline.operators import balance


def plain(t, c):
    """eCDF and eQQ distances of two lists, by loops."""
    spots = sorted({*t, *c})
    gaps = [abs(sum(x <= s for x in t) / len(t) - sum(x <= s for x in c) / len(c)) for s in spots]
    small, large = sorted([sorted(t), sorted(c)], key=len)
    diffs = []
    for k, x in enumerate(small):
        at = k * (len(large) - 1) / (len(small) - 1) if len(small) > 1 else 0
        low = min(int(at + 1e-9), len(large) - 1)
        high = min(low + 1, len(large) - 1)
        diffs.append(abs(x - (large[low] + (at - low) * (large[high] - large[low]))))
    return [sum(gaps) / len(gaps), max(gaps), sum(diffs) / len(diffs), statistics.median(diffs), max(diffs)]


def found(spark, rows, matched=None):
    df = spark.createDataFrame(rows, "id long, treated boolean, x double, flag boolean, used boolean").repartition(3)
    got = balance.balance_distances(df, "treated", ["x", "flag"], matched).collect()
    return {(r.sample, r.variable): [r.ecdf_mean, r.ecdf_max, r.eqq_mean, r.eqq_median, r.eqq_max] for r in got}


@pytest.mark.parametrize(("seed", "n_t", "n_c", "piece"), [(1, 40, 90, 4096), (2, 75, 30, 3), (3, 50, 50, 7), (4, 1, 20, 4096)])
def test_distances_equal_the_loops(spark, monkeypatch, seed, n_t, n_c, piece):
    monkeypatch.setattr(balance, "PIECE", piece)
    rnd = random.Random(seed)
    rows = [(i, i < n_t, rnd.choice([0.0, round(rnd.gauss(0, 1), 1), rnd.gauss(i < n_t, 2)]), rnd.random() < 0.4, rnd.random() < 0.6)
            for i in range(n_t + n_c)]
    rows[0] = (*rows[0][:4], True)
    got = found(spark, rows, "used")
    for sample, some in (("all", rows), ("matched", [r for r in rows if r[4]])):
        for name, at in (("x", 2), ("flag", 3)):
            want = plain([float(r[at]) for r in some if r[1]], [float(r[at]) for r in some if not r[1]])
            assert got[sample, name] == pytest.approx(want, abs=1e-9)


def test_missing_values_and_empty_groups(spark):
    rows = [(1, True, 1.0, None, True), (2, False, 4.0, True, True), (3, False, None, False, True), (4, None, 9.0, True, True)]
    got = found(spark, rows)
    assert got["all", "x"] == [0.5, 1.0, 3.0, 3.0, 3.0]
    assert got["all", "flag"] == [None] * 5
    assert found(spark, rows[:0]) == {}
