import random

import numpy as np
import pytest

from anchorline.operators import long_runs
from anchorline.operators import matching as M


def one_by_one(rows):
    """The rule as a plain loop: rows of (id, score, treated)."""
    free = {i: s for i, s, t in rows if not t}
    pairs = set()
    for i, s, _ in sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0])):
        if not free:
            break
        best = min(free, key=lambda c: (abs(free[c] - s), -free[c], c))
        pairs.add((i, best))
        del free[best]
    return pairs


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, score double, treated boolean").repartition(3)


def matched(spark, rows, **limits):
    out = M.greedy_match(frame(spark, rows), "id", "treated", "score", **limits).collect()
    assert len({r.control_id for r in out}) == len(out)
    return {(r.treated_id, r.control_id) for r in out}


def sample(seed, n, share, grid, shift=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        treated = rnd.random() < share
        x = rnd.random() * (1 - shift) + (shift if treated else 0.0)
        rows.append((i, round(x * grid) / grid, treated))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "seed,n,share,grid,shift,limits",
    [
        (1, 300, 0.2, 1024, 0.0, {}),
        (2, 400, 0.3, 64, 0.0, {"block_cells": 16, "task_cells": 10_000}),
        (3, 300, 0.5, 512, 0.2, {"block_cells": 16, "task_cells": 10_000}),
        (4, 80, 0.4, 256, 0.1, {"block_cells": 7, "task_cells": 10, "reach": 1, "max_units": 3}),
        (5, 60, 0.7, 128, 0.0, {"block_cells": 5, "task_cells": 10, "reach": 1, "max_units": 3}),
        (6, 90, 0.5, 512, 0.3, {"block_cells": 9, "task_cells": 10}),
    ],
)
def test_equals_the_loop(spark, seed, n, share, grid, shift, limits):
    rows = sample(seed, n, share, grid, shift)
    assert matched(spark, rows, **limits) == one_by_one(rows)


def test_one_score_shared_by_most_units(spark):
    rows = [(i, 0.5, i % 3 == 0) for i in range(300)] + [(1000 + i, i / 32, i % 2 == 0) for i in range(32)]
    assert matched(spark, rows, block_cells=8, task_cells=16, max_units=7) == one_by_one(rows)


def bell(seed, n, shift):
    rng = np.random.default_rng(seed)
    treated = rng.random(n) < 0.5
    scores = rng.normal(size=n) + np.where(treated, shift, 0)
    return [(i, float(x), bool(t)) for i, (x, t) in enumerate(zip(scores, treated))]


@pytest.mark.parametrize("shift", [0.5, -0.5])
def test_long_runs_take_few_rounds(spark, caplog, shift):
    rows = bell(1, 2500, shift)
    with caplog.at_level("INFO", logger="anchorline.operators.matching"):
        assert matched(spark, rows, block_cells=50, task_cells=60) == one_by_one(rows)
    told = [[int(x) for x in r.getMessage().split() if x.isdigit()] for r in caplog.records]
    blocks, rounds = max(told)
    assert blocks >= 30 and rounds <= blocks / 3


def test_long_run_of_shared_scores_goes_on_where_its_lists_end(spark):
    rows = [(i, round(x, 1), t) for i, x, t in bell(3, 1500, -0.7)]
    assert matched(spark, rows, block_cells=4, task_cells=5, reach=1, max_units=9) == one_by_one(rows)


def test_borders_of_a_coarse_line():
    line = [long_runs.Slice(0, 5.0, 3, 1), long_runs.Slice(0, 4.0, 0, 4), long_runs.Slice(1, 3.0, 4, 1), long_runs.Slice(2, 1.0, 0, 9)]
    assert long_runs.coarse(line) == {0: 0, 1: 1, 2: 0}
    stack = (long_runs.Left(3, 1, (7,), 0, 2), (long_runs.Left(1, 0, (8,), 1, 5), None))
    assert long_runs.popped(stack, 4) == (long_runs.Left(1, 0, (8,), 3, 3), None)
    assert long_runs.popped(stack, 9) is None
    assert long_runs.top_of(stack, 1, 0) == ((stack[0],), True) and long_runs.top_of(stack, 1, 3)[1] is False


def test_no_controls(spark):
    assert matched(spark, [(1, 0.2, True), (2, 0.3, True)]) == set()


def test_pairs_sample_and_counts(spark):
    rows = [(1, 0.9, True), (2, 0.5, True), (3, 0.4, True), (4, 0.45, False), (5, 0.1, False), (6, 0.6, False)]
    df = frame(spark, rows)
    kept = M.common_support(df, "treated", "score")
    assert {r.id for r in kept.collect()} == {2, 3, 4, 6}
    pairs = M.greedy_match(kept, "id", "treated", "score")
    table = {(r.treated_id, r.control_id) for r in M.pair_table(df, pairs, "id", "treated").collect()}
    assert table == {(1, None), (2, 4), (3, 6)}
    assert {(r.id, r.weights) for r in M.matched_sample(df, pairs, "id").collect()} == {
        (2, 1.0), (3, 1.0), (4, 1.0), (6, 1.0)
    }


def test_missing_and_repeated_units_fail(spark):
    good = [(1, 0.9, True), (2, 0.5, False)]
    M.require_units(frame(spark, good), "id", ["score"])
    with pytest.raises(ValueError, match="not unique"):
        M.require_units(frame(spark, good + [(2, 0.1, True)]), "id", ["score"])
    with pytest.raises(ValueError, match="missing"):
        M.require_units(frame(spark, good + [(3, None, True)]), "id", ["score"])
    with pytest.raises(ValueError, match="missing"):
        M.require_units(frame(spark, good + [(3, float("nan"), True)]), "id", ["score"])


def test_propensity_scores_are_the_likelihood_fit(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 2)) * [1.0, 30.0] + [2.0, 40.0]
    y = rnd.random(400) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.03 * x[:, 1])))
    beta, design = np.zeros(3), np.column_stack([np.ones(400), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    df = spark.createDataFrame(
        [(i, float(a), float(b), bool(t)) for i, ((a, b), t) in enumerate(zip(x, y))],
        "id long, a double, b double, treated boolean",
    )
    got = {r.id: r.distance for r in M.propensity_scores(df, "treated", ["a", "b"]).collect()}
    want = 1 / (1 + np.exp(-design @ beta))
    assert max(abs(got[i] - want[i]) for i in got) < 1e-9


def test_balance_and_counts(spark):
    df = spark.createDataFrame(
        [(True, 1.0, True, False), (True, 3.0, True, False), (False, 2.0, True, False), (False, 6.0, False, True)],
        "treated boolean, x double, matched boolean, discarded boolean",
    )
    rows = {r["sample"]: r for r in M.balance_summary(df, "treated", ["x"], "matched").collect()}
    assert (rows["all"].mean_treated, rows["all"].mean_control) == (2.0, 4.0)
    assert rows["all"].std_mean_diff == pytest.approx(-2.0 / 2**0.5)
    assert (rows["matched"].mean_control, rows["matched"].mean_diff) == (2.0, 0.0)
    counts = {r.units: (r.treated, r.control) for r in M.sample_counts(df, "treated", "matched", "discarded").collect()}
    assert counts == {"all": (2, 2), "matched": (2, 1), "unmatched": (0, 0), "discarded": (0, 1)}
