"""Greedy matching of one bounded slice of the score line; runs inside Spark tasks.

A cell stands for all units of one score: `n_t` treated and `n_c` control units, whose places in the order
of units start at `t_start` and `c_start`. Cells come in descending score.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd

FLOW, CELL, STATUS = 0, 1, 2
COLUMNS = ["kind", "run", "block", "cell", "score", "n_t", "n_c", "t_start", "c_start", "marks", "fail_above", "fail_below"]
SCHEMA = (
    "kind int, run long, block long, cell long, score double, n_t long, n_c long, t_start long, c_start long, "
    "marks array<long>, fail_above boolean, fail_below boolean"
)


def _find(parent: list[int], i: int) -> int:
    root = i
    while parent[root] != root:
        root = parent[root]
    while parent[i] != root:
        parent[i], i = root, parent[i]
    return root


def without_taken(cells: pd.DataFrame) -> pd.DataFrame:
    """Cells in descending score without the first `skip` controls of each block; they go from the low scores up in
    blocks of side -1, else from the high scores down."""
    n_c, c_start = cells["n_c"].to_numpy().copy(), cells["c_start"].to_numpy().copy()
    for block in cells.loc[cells["skip"] > 0, "block"].unique():
        at = np.nonzero(cells["block"].to_numpy() == block)[0]
        if cells["side"].iloc[at[0]] < 0:
            at = at[::-1]
        before = np.cumsum(n_c[at]) - n_c[at]
        gone = np.clip(cells["skip"].iloc[at[0]] - before, 0, n_c[at])
        n_c[at] -= gone
        c_start[at] += gone
    return cells.assign(n_c=n_c, c_start=c_start)


def marks(left: pd.DataFrame) -> list[int]:
    """Checksums of the lowest 1, 2, 4 ... free controls, and of all of them."""
    cell, n_c = (left[c].to_numpy(np.int64)[::-1] for c in ("cell", "n_c"))
    upto, out = np.cumsum(n_c), []
    total = int(upto[-1]) if len(upto) else 0
    for units in [*(1 << i for i in range((total - 1).bit_length() if total else 0)), total]:
        end = int(np.searchsorted(upto, units)) + 1
        part = np.stack([cell[:end], np.minimum(n_c[:end], units - upto[:end] + n_c[:end])])
        digest = hashlib.blake2b(np.ascontiguousarray(part[:, part[1] > 0]).tobytes(), digest_size=8).digest()
        out.append(int.from_bytes(digest, "little", signed=True))
    return out


def solve(cells: pd.DataFrame, max_units: int, keep_left: bool) -> pd.DataFrame:
    """Match the active treated cells to the controls at hand.

    `block`, `side` and `skip` say which controls are taken (see `without_taken`). Constant columns of `cells`: `run`;
    `above`/`below`, the nearest control scores outside the run (NaN for none); `more_above`/`more_below`, whether the run
    has further controls that are not at hand.
    A treated unit takes the nearest free control; at equal distance the one with the higher score.
    Stops at the first unit whose choice may depend on controls not at hand.

    Returns the flows (`n_c` treated units from place `t_start` get the controls from place `c_start`),
    with `keep_left` the active cells as left over, and per block a status row, with the `marks` of what the active ones
    leave. A `fail` flag tells that some unit was as near to an outside control as to its own match, so that the run may
    not be closed on that side.
    """
    cells = without_taken(cells.sort_values("cell", kind="stable"))
    n = len(cells)
    head = cells.iloc[0]
    above, below = float(head["above"]), float(head["below"])
    more_above, more_below = bool(head["more_above"]), bool(head["more_below"])
    score = cells["score"].tolist()
    n_t, n_c = cells["n_t"].tolist(), cells["n_c"].tolist()
    t_at, c_at = cells["t_start"].tolist(), cells["c_start"].tolist()
    active = cells["active"].tolist()

    # up[i + 1] leads to the nearest free control cell at or above i, down[i] at or below; 0 and n: none
    up = list(range(n + 1))
    down = list(range(n + 1))
    for i in range(n):
        if n_c[i] == 0:
            up[i + 1] = i
            down[i] = i + 1

    flows: list[tuple[int, int, int]] = []
    fail_above = fail_below = stopped = False
    for i in range(n):
        if not active[i]:
            continue
        while n_t[i] and not stopped:
            a = _find(up, i + 1) - 1
            b = _find(down, i + 1) if i + 1 < n else n
            if (a < 0 and more_above) or (b >= n and more_below):
                stopped = True
                break
            to_a = score[a] - score[i] if a >= 0 else math.inf
            to_b = score[i] - score[b] if b < n else math.inf
            distance = min(to_a, to_b)
            fail_above = fail_above or distance >= above - score[i]
            fail_below = fail_below or distance >= score[i] - below
            if distance == math.inf:
                break
            chosen = a if to_a <= to_b else b
            took = min(n_t[i], n_c[chosen])
            for k in range(0, took, max_units):
                flows.append((t_at[i] + k, c_at[chosen] + k, min(max_units, took - k)))
            n_t[i] -= took
            t_at[i] += took
            n_c[chosen] -= took
            c_at[chosen] += took
            if n_c[chosen] == 0:
                up[chosen + 1] = chosen
                down[chosen] = chosen + 1
        if stopped:
            break

    left = cells[["block", "cell", "score"]].assign(kind=CELL, n_t=n_t, n_c=n_c, t_start=t_at, c_start=c_at)
    done = active if not stopped else active[:i] + [False] * (n - i)
    waiting = [t if on and not d else 0 for t, on, d in zip(n_t, active, done)]
    status = (
        left.assign(n_t=waiting).groupby("block", as_index=False)
        .agg(n_t=("n_t", "sum"), n_c=("n_c", "sum"))
        .assign(kind=STATUS)
    )
    left = left[active]
    left = left[(left["n_t"] > 0) | (left["n_c"] > 0)]
    status = status.assign(marks=[marks(left)] * len(status))
    flow = pd.DataFrame(
        np.array(flows, dtype=np.int64).reshape(-1, 3), columns=["t_start", "c_start", "n_c"]
    ).assign(kind=FLOW)
    parts = [flow, status, left] if keep_left else [flow, status]
    numbers = [c for c in COLUMNS[:-3]]
    for part in parts:
        part[[c for c in numbers if c not in part]] = 0
    out = pd.concat([p.reindex(columns=[*numbers, "marks"]) for p in parts], ignore_index=True)
    out["marks"] = out["marks"].where(out["marks"].notna(), None)
    return out.assign(run=head["run"], fail_above=fail_above, fail_below=fail_below)[COLUMNS]
