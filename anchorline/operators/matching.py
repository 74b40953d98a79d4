"""Propensity scores and 1:1 matching.

Greedy matching without replacement goes through the treated units one by one, so it looks sequential.
Three facts make it a distributed job:

* All units of one score behave alike. The line of scores is reduced to one row per score (a cell) before
  anything else, so a score shared by very many units costs one row.
* On a line, a choice depends on near controls only. The line is cut into blocks of a fixed number of
  cells, and the blocks are matched independently. A cut is right when each treated unit found its control
  nearer than any control beyond the cut. Blocks on both sides of a cut that fails are joined to a run and
  matched again, until all cuts hold.
* The blocks of a run too long for one task are matched at once, each on a guess of what the blocks above have taken and
  left. Those whose guess was wrong are matched again, until all hold (`long_runs`). A task reads one block and the nearest
  blocks with free controls on both sides; where those run dry, the next round goes on from there.

The result equals the one-by-one rule in every case. Units only come back at the end: they are numbered
in score order and joined by number to the flows between cells.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import count

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from anchorline.operators import greedy, long_runs
from anchorline.operators.batches import with_row_index
from anchorline.session import scratch_path, small_table, stable

cloudpickle.register_pickle_by_value(greedy)  # executors need not have the package installed
log = logging.getLogger(__name__)
#: Slices of a block in the coarse line from which borders are guessed.
SLICES = 16


def unit_problems(df: DataFrame, id_col: str, required: Sequence[str]) -> DataFrame:
    """Units that are listed more than once or lack a required value: (id, n, missing)."""
    kinds = dict(df.dtypes)
    missing = F.lit(False)
    for c in [id_col, *required]:
        missing = missing | F.col(c).isNull()
        if kinds[c] in ("double", "float"):
            missing = missing | F.isnan(c)
    units = df.groupBy(id_col).agg(F.count("*").alias("n"), F.max(missing).alias("missing"))
    return units.where("n > 1 or missing")


def require_units(df: DataFrame, id_col: str, required: Sequence[str]) -> DataFrame:
    """Fail unless ids are unique and no required value is missing."""
    found = unit_problems(df, id_col, required).agg(F.max("missing").alias("missing"), F.max("n").alias("n")).first()
    if found["missing"]:
        raise ValueError(f"missing values in {[id_col, *required]}")
    if found["n"] is not None:
        raise ValueError(f"{id_col} is not unique")
    return df


def propensity_scores(df: DataFrame, treated: str, covariates: Sequence[str], score: str = "distance") -> DataFrame:
    """Add the probability of treatment by logistic regression on the covariates: the maximum-likelihood
    fit by reweighted least squares, one pass over the data per iteration."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    ready = VectorAssembler(inputCols=list(covariates), outputCol="__x").transform(
        df.withColumn("__y", F.col(treated).cast("double"))
    )
    fit = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="__x", labelCol="__y", predictionCol=score, maxIter=50, tol=1e-10,
    ).fit(ready)
    return fit.transform(ready).drop("__x", "__y")


def support_bounds(df: DataFrame, treated: str, score: str) -> Column:
    """Score range of both groups, as one scalar subquery."""
    t, s = F.col(treated), F.col(score)
    return df.agg(
        F.struct(
            F.min(F.when(t, s)).alias("t_low"), F.max(F.when(t, s)).alias("t_high"),
            F.min(F.when(~t, s)).alias("c_low"), F.max(F.when(~t, s)).alias("c_high"),
        ).alias("bounds")
    ).scalar()


def in_support(df: DataFrame, treated: str, score: str, flag: str = "in_support") -> DataFrame:
    """Flag units whose score lies within the score range of the other group."""
    bounds = support_bounds(df, treated, score)
    s = F.col(score)
    return df.withColumn(
        flag,
        F.when(F.col(treated), s.between(bounds["c_low"], bounds["c_high"]))
        .otherwise(s.between(bounds["t_low"], bounds["t_high"])),
    )


def common_support(df: DataFrame, treated: str, score: str) -> DataFrame:
    """Drop units of both groups outside the other group's score range."""
    return in_support(df, treated, score, "__in").where("__in").drop("__in")


@dataclass
class _Run:
    """Neighbouring blocks that are matched together."""

    first: int
    last: int
    key: int
    solved: bool = False
    fail_above: bool = False
    fail_below: bool = False
    tasks: list[int] = field(default_factory=list)


@dataclass
class _Line:
    """The written cells and what the driver knows about each block (a few numbers per block)."""

    cells: DataFrame
    cells_in: list[int]
    controls_in: list[int]
    treated_in: list[int]
    nearest_above: list[float]
    nearest_below: list[float]
    steps: list[str] = field(default_factory=list)
    keys: Iterator[int] = field(default_factory=count)


def _nearest(values: list[float | None]) -> list[float]:
    """For each position the last known value before it."""
    out, last = [], float("nan")
    for v in values:
        out.append(last)
        last = last if v is None else v
    return out


def _line(units: DataFrame, block_cells: int) -> _Line:
    """Cells in descending score, cut into blocks of `block_cells`."""
    t = F.col("treated")
    counted = units.groupBy("score").agg(
        F.count_if(t).alias("n_t"), F.count_if(~t).alias("n_c"),
        F.min(F.when(t, F.col("place"))).alias("t_start"), F.min(F.when(~t, F.col("place"))).alias("c_start"),
    )
    cells = (
        with_row_index(counted, [F.col("score").desc()], "cell")
        .withColumn("block", F.call_function("div", F.col("cell"), F.lit(block_cells)))
        .select("block", "cell", "score", "n_t", "n_c", "t_start", "c_start")
        .fillna(0, ["t_start", "c_start"])
    )
    free = F.when(F.col("n_c") > 0, F.col("score"))
    stats = sorted(
        cells.groupBy("block").agg(
            F.count("*").alias("cells"), F.sum("n_c").alias("n_c"), F.sum("n_t").alias("n_t"), F.max(free).alias("high"), F.min(free).alias("low")
        ).collect(),
        key=lambda r: r["block"],
    )
    return _Line(
        cells, [r["cells"] for r in stats], [r["n_c"] for r in stats], [r["n_t"] for r in stats],
        _nearest([r["low"] for r in stats]), _nearest([r["high"] for r in reversed(stats)])[::-1],
    )


_ASSIGN = (
    "source long, block long, run long, active boolean, side int, skip long, above double, below double, "
    "more_above boolean, more_below boolean"
)


def _solve(line: _Line, cells: DataFrame, max_units: int, keep_left: bool) -> DataFrame:
    """Match each run of assigned cells in one task; the result is written before it is used."""
    def task(pdf):
        return greedy.solve(pdf, max_units, keep_left)

    path = scratch_path(cells.sparkSession, "match-step")
    cells.groupBy("run").applyInPandas(task, greedy.SCHEMA).write.parquet(path)
    line.steps.append(path)
    return cells.sparkSession.read.schema(greedy.SCHEMA).parquet(path)


def _match_short(line: _Line, runs: list[_Run], max_units: int) -> None:
    plan = small_table(line.cells.sparkSession, [
        (None, block, run.key, True, 0, 0, line.nearest_above[run.first], line.nearest_below[run.last], False, False)
        for run in runs for block in range(run.first, run.last + 1)
    ], _ASSIGN)  # one row per block
    solved = _solve(line, line.cells.join(F.broadcast(plan), "block"), max_units, keep_left=False)
    by_key = {r.key: r for r in runs}
    status = solved.where(F.col("kind") == greedy.STATUS)
    for row in status.select("run", "fail_above", "fail_below").distinct().collect():
        run = by_key[row["run"]]
        run.fail_above, run.fail_below = run.fail_above or row["fail_above"], run.fail_below or row["fail_below"]
    for run in runs:
        run.tasks = [run.key]


def _chains(line: _Line, runs: list[_Run], reach: int) -> dict[int, long_runs.Chain]:
    """What is known of each run before its first round: the counts of its blocks, and a guess from a coarse line."""
    spark = line.cells.sparkSession
    owners = small_table(
        spark, [(block, run.key) for run in runs for block in range(run.first, run.last + 1)], "block long, owner long"
    )
    width = max(1, max(line.cells_in) // SLICES)
    slices = line.cells.join(F.broadcast(owners), "block").groupBy(
        "owner", "block", F.call_function("div", F.col("cell"), F.lit(width)).alias("slice")
    ).agg(F.avg("score").alias("score"), F.sum("n_t").alias("n_t"), F.sum("n_c").alias("n_c"))
    of: dict[int, list[long_runs.Slice]] = {run.key: [] for run in runs}
    for row in sorted(slices.collect(), key=lambda r: (r["block"], r["slice"])):  # a few rows per block
        of[row["owner"]].append(long_runs.Slice(row["block"], row["score"], row["n_t"], row["n_c"]))
    return {
        run.key: long_runs.Chain(
            range(run.first, run.last + 1), line.controls_in, line.treated_in, long_runs.coarse(of[run.key]), reach,
            max(line.cells_in),
        )
        for run in runs
    }


def _match_long(line: _Line, runs: list[_Run], max_units: int, reach: int) -> None:
    """All blocks of all runs at once on guessed borders, then those again whose border came out otherwise."""
    spark = line.cells.sparkSession
    initial = stable(line.cells.repartition("block").sortWithinPartitions("block", "cell"))  # read by block
    chains, paths, rounds = _chains(line, runs, reach), {}, 0
    while True:
        tasks: dict[int, tuple[_Run, int, long_runs.Given]] = {}
        from_line, from_left = [], []
        for run in runs:
            for block, given in chains[run.key].due():
                key = next(line.keys)
                tasks[key] = run, block, given
                lower, more_below = chains[run.key].lower(block, given.below)
                outside = line.nearest_above[run.first], line.nearest_below[run.last], given.more, more_below
                own = (given.own, block, key, True, 0, given.skip, *outside)
                (from_line if given.own is None else from_left).append(own)
                from_left += [(x.key, x.block, key, False, -1, x.gone, *outside) for x in given.above]
                from_line += [(None, b, key, False, 1, skip, *outside) for b, skip in lower]
        if not tasks:
            break
        rounds += 1
        cells = initial.join(F.broadcast(small_table(spark, from_line, _ASSIGN)), "block").drop("source")
        if from_left:
            left = spark.read.schema(greedy.SCHEMA).parquet(*sorted({paths[row[0]] for row in from_left}))
            left = left.where(F.col("kind") == greedy.CELL).withColumnRenamed("run", "source").select(
                "source", *line.cells.columns
            )
            plan = small_table(spark, from_left, _ASSIGN)  # a few rows per block
            cells = cells.unionByName(left.join(F.broadcast(plan), ["source", "block"]).drop("source"))
        solved = _solve(line, cells, max_units, keep_left=True)
        paths |= dict.fromkeys(tasks, line.steps[-1])
        found: dict[int, dict[int, Row]] = {}
        for row in solved.where(F.col("kind") == greedy.STATUS).collect():
            found.setdefault(row["run"], {})[row["block"]] = row
        for key, (run, block, given) in tasks.items():
            rows = found[key]
            lower, _ = chains[run.key].lower(block, given.below)
            taken = sum(line.controls_in[b] - skip - rows[b]["n_c"] for b, skip in lower)
            own = rows[block]
            chains[run.key].take(block, long_runs.Solved(
                key, given, [x.free - rows[x.block]["n_c"] for x in given.above], given.below + taken,
                tuple(own["marks"]), own["n_c"], own["n_t"] > 0, own["fail_above"], own["fail_below"],
            ))
    log.info("long runs: %d blocks in %d rounds", sum(r.last - r.first + 1 for r in runs), rounds)
    for run in runs:
        final = chains[run.key].final()
        run.tasks = [x.key for x in final]
        run.fail_above = run.fail_above or any(x.fail_above for x in final)
        run.fail_below = run.fail_below or any(x.fail_below for x in final)


def _merge(runs: list[_Run], keys: Iterator[int], long: set[int]) -> list[_Run]:
    """Join runs whose cuts fail. A long run takes in half as many blocks again on a side that fails, so that it is
    matched anew a few times only, however far its choices spread."""
    joined = [False] * len(runs)  # whether a run is joined to the one before
    for i, (before, run) in enumerate(zip(runs, runs[1:]), 1):
        joined[i] = before.fail_below or run.fail_above
    for i, run in enumerate(runs):
        if run.key in long:
            far = (run.last - run.first + 1) // 2
            for j in range(i + 1, len(runs)):
                if not run.fail_below or runs[j].first > run.last + max(far, 1):
                    break
                joined[j] = True
            for j in range(i, 0, -1):
                if not run.fail_above or runs[j - 1].last < run.first - max(far, 1):
                    break
                joined[j] = True
    merged: list[_Run] = []
    for run, to_last in zip(runs, joined, strict=True):
        if to_last:
            merged[-1] = _Run(merged[-1].first, run.last, next(keys))
        else:
            merged.append(run)
    return merged


def greedy_match(scored: DataFrame, id_col: str, treated: str, score: str, block_cells: int = 100_000,
                 task_cells: int = 1_000_000, reach: int = 2, max_units: int = 50_000) -> DataFrame:
    """Nearest-neighbour 1:1 matching without replacement: (treated_id, control_id, distance).

    Treated units choose in order of score (high first), then id. Each takes the nearest free control; at
    equal distance the control with the higher score, then the smaller id. Treated units beyond the number
    of controls stay unmatched. `block_cells` and `task_cells` bound what one task holds; they do not
    change the result.
    """
    # Each unit's place in the order of its group: one numbering, controls follow the treated
    order = [F.col("treated").desc(), F.col("score").desc(), F.col("id")]
    units = with_row_index(
        scored.select(
            F.col(id_col).alias("id"), F.col(score).cast("double").alias("score"), F.col(treated).alias("treated")
        ),
        order, "place",
    )
    line = _line(units, block_cells)
    runs = [_Run(b, b, next(line.keys)) for b in range(len(line.cells_in))]
    while True:
        todo = [r for r in runs if not r.solved]
        size = {r.key: sum(line.cells_in[r.first: r.last + 1]) for r in todo}
        short = [r for r in todo if r.first == r.last or size[r.key] <= task_cells]
        long = [r for r in todo if r not in short]
        if short:
            _match_short(line, short, max_units)
        if long:
            _match_long(line, long, max_units, reach)
        for r in todo:
            r.solved = True
        merged = _merge(runs, line.keys, {r.key for r in long})
        if len(merged) == len(runs):
            break
        runs = merged

    spark = scored.sparkSession
    final = small_table(spark, ((key,) for r in runs for key in r.tasks), "run long")  # one row per run or block
    links = (
        spark.read.schema(greedy.SCHEMA).parquet(*line.steps)
        .where(F.col("kind") == greedy.FLOW)
        .join(F.broadcast(final), "run", "left_semi")
        .repartition("t_start")
        .select("t_start", "c_start", F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)).alias("k"))
        .select((F.col("t_start") + F.col("k")).alias("t_place"), (F.col("c_start") + F.col("k")).alias("c_place"))
    )
    takers = units.where("treated").select(
        F.col("place").alias("t_place"), F.col("id").alias("treated_id"), F.col("score").alias("t_score")
    )
    givers = units.where(~F.col("treated")).select(
        F.col("place").alias("c_place"), F.col("id").alias("control_id"), F.col("score").alias("c_score")
    )
    return (
        links.join(takers, "t_place").join(givers, "c_place")
        .select("treated_id", "control_id", F.abs(F.col("t_score") - F.col("c_score")).alias("distance"))
    )


def pair_table(scored: DataFrame, pairs: DataFrame, id_col: str, treated: str) -> DataFrame:
    """Every treated id with its control id, NULL where there is none."""
    return scored.where(F.col(treated)).select(F.col(id_col).alias("treated_id")).join(
        pairs.select("treated_id", "control_id"), "treated_id", "left"
    )


def matched_ids(pairs: DataFrame, id_col: str) -> DataFrame:
    return pairs.select(F.explode(F.array("treated_id", "control_id")).alias(id_col))


def matched_sample(scored: DataFrame, pairs: DataFrame, id_col: str, weight: str = "weights") -> DataFrame:
    """Rows of both sides of all pairs, with their weight."""
    return scored.join(matched_ids(pairs, id_col), id_col, "left_semi").withColumn(weight, F.lit(1.0))


def balance_summary(df: DataFrame, treated: str, covariates: Sequence[str], matched: str | None = None) -> DataFrame:
    """Means per group, SD of the controls and mean difference, plain and divided by the SD of all
    treated: one row per (sample, variable), 'all' and, with a `matched` flag column, 'matched'."""
    t = F.col(treated)
    samples = {"all": F.lit(True)} | ({"matched": F.col(matched)} if matched else {})
    aggs, rows = [], []
    for x in covariates:
        aggs.append(F.stddev_samp(F.when(t, F.col(x))).alias(f"{x}__sd"))
        for name, use in samples.items():
            aggs += [
                F.avg(F.when(t & use, F.col(x))).alias(f"{x}__{name}_t"),
                F.avg(F.when(~t & use, F.col(x))).alias(f"{x}__{name}_c"),
                F.stddev_samp(F.when(~t & use, F.col(x))).alias(f"{x}__{name}_sd_c"),
            ]
            gap = F.col(f"{x}__{name}_t") - F.col(f"{x}__{name}_c")
            rows.append(
                F.struct(
                    F.lit(name).alias("sample"), F.lit(x).alias("variable"),
                    F.col(f"{x}__{name}_t").alias("mean_treated"), F.col(f"{x}__{name}_c").alias("mean_control"),
                    F.col(f"{x}__{name}_sd_c").alias("sd_control"), gap.alias("mean_diff"),
                    (gap / F.col(f"{x}__sd")).alias("std_mean_diff"),
                )
            )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def sample_counts(df: DataFrame, treated: str, matched: str, discarded: str) -> DataFrame:
    """Numbers of units: all, matched, unmatched and discarded, per group."""
    t, m, d = F.col(treated), F.col(matched), F.col(discarded)
    parts = {"all": F.lit(True), "matched": m, "unmatched": ~m & ~d, "discarded": d}
    return df.agg(
        *(F.count_if(t & use).alias(f"{name}_t") for name, use in parts.items()),
        *(F.count_if(~t & use).alias(f"{name}_c") for name, use in parts.items()),
    ).select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(name).alias("units"), F.col(f"{name}_t").alias("treated"),
                        F.col(f"{name}_c").alias("control"),
                    )
                    for name in parts
                )
            )
        )
    )
