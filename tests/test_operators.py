import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from anchorline.functions import clean, concepts, times
from anchorline.operators import batches, cohort, extremes, firsts, lookup, readmit, reshape, windows

H = lambda n: dt.timedelta(hours=n)


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


# ---- cleaning

def test_censored_text(spark):
    df = spark.createDataFrame([(v,) for v in ["<5", ">200", "7.2", "7d", "n/a", None, " 8 ", "1e2", "-.5"]], "r string")
    got = {r[0]: tuple(r)[1:] for r in clean.censored_number(df.withColumn("t", F.col("r")), "r").select(
        "t", "censor_low", "censor_high", "r").collect()}
    assert got == {
        "<5": (True, False, None), ">200": (False, True, None), "7.2": (False, False, 7.2), "7d": (False, False, None),
        "n/a": (False, False, None), None: (None, None, None), " 8 ": (False, False, 8.0), "1e2": (False, False, 100.0),
        "-.5": (False, False, -0.5),
    }


def test_pattern_anchors_the_first_branch_only(spark):
    names = ["potassium chloride", "x potassium", "sodium phosphate", "x calcium chloride"]
    df = spark.createDataFrame([(n,) for n in names], "med string")
    kept = df.where(clean.matches("med", concepts.ELECTROLYTE_MEDS_PATTERN))
    assert rows(kept) == [("potassium chloride",), ("sodium phosphate",), ("x calcium chloride",)]


def test_limits_are_half_open(spark):
    df = spark.createDataFrame([(x,) for x in (39.0, 40.0, 299.0, 300.0, None)], "x double")
    assert rows(df.where(clean.within_limits("x", 40.0, 300.0))) == [(299.0,), (40.0,)]
    assert rows(df.where(clean.within_limits("x", 40.0, None, low_open=True))) == [(299.0,), (300.0,)]
    assert df.where(clean.within_limits("x", None, None)).count() == 5


def test_exclusion_drops_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "f string")
    assert rows(clean.exclude_value(df, "f", "a")) == [("b",)]


def test_override_by_id_and_date(spark):
    days = [dt.date(2018, 1, 13), dt.date(2018, 1, 20), dt.date(2017, 1, 1), dt.date(2016, 1, 1)]
    df = spark.createDataFrame(
        [(124, days[0], days[3]), (124, days[1], days[3]), (215, days[2], None), (1, days[2], days[3])],
        "id long, start date, end date",
    )
    rules = spark.createDataFrame([(124, days[0], days[0]), (215, None, days[1])], "id long, start date, fixed date")
    got = rows(clean.override(df, rules, ["id"], "end", "fixed", only_when="start"))
    assert got == sorted(
        [(124, days[0], days[0]), (124, days[1], days[3]), (215, days[2], days[1]), (1, days[2], days[3])], key=str
    )


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, True, None)], "A int, pre_b int, C int, D boolean, E boolean")
    lower = clean.rename_lower(df, {"C": "See"})
    assert lower.columns == ["a", "pre_b", "see", "d", "e"]
    assert clean.front(lower, ["see", "pre*"], drop=["a"]).columns == ["see", "pre_b", "d", "e"]
    assert rows(clean.dense_booleans(lower).select("d", "e")) == [(True, False)]
    assert clean.pick(df, {"x": "C"}).columns == ["x"]
    assert clean.tag(df, "g", "v").first()["g"] == "v"


# ---- times

def test_compose_needs_both_parts(spark):
    df = spark.createDataFrame(
        [(at(3), at(1, 5, 6, 7)), (None, at(1)), (at(3), None)], "d timestamp_ntz, t timestamp_ntz"
    )
    got = [r[0] for r in df.select(times.compose("d", "t")).collect()]
    assert got == [at(3, 5, 6, 7), None, None]


def test_compose_from_text_time(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 3), "05:06:07"), (dt.date(2024, 1, 3), "nope")], "d date, t string")
    got = [r[0] for r in df.select(times.compose("d", times.parse_time_of_day("t"))).collect()]
    assert got == [at(3, 5, 6, 7), None]


def test_elapsed_and_age(spark):
    df = spark.createDataFrame([(at(3, 12), at(1)), (at(1), at(3))], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(times.elapsed("a", "b"), times.elapsed("a", "b", "hours"), times.whole_years("a", "b")).collect()
    assert [tuple(r) for r in got] == [(2.5, 60.0, 0), (-2.0, -48.0, 0)]
    old = spark.createDataFrame([(dt.datetime(2023, 12, 31), dt.datetime(1980, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert old.select(times.whole_years("a", "b")).first()[0] == 43


def test_other_session_zones_are_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "US/Central")
    try:
        with pytest.raises(RuntimeError, match="configure"):
            times.micros("ts")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# ---- windows

def _random_windows(spark, seed):
    rnd = random.Random(seed)
    points = [(rnd.choice([1, 1, 1, 2, None]), at(1, 0, rnd.randrange(20000)), i) for i in range(200)]
    points += [(1, None, 999), (1, at(-20000), 998)]
    spans = []
    for i in range(40):
        start = at(1, 0, rnd.randrange(20000))
        stop = rnd.choice([start + dt.timedelta(minutes=rnd.randrange(-300, 4000)), None])
        spans.append((rnd.choice([1, 1, 2, None]), start, stop, i))
    return points, spans


@pytest.mark.parametrize("width", [H(1), H(24), H(24 * 400)])
def test_interval_join_equals_all_pairs_check(spark, width):
    points, spans = _random_windows(spark, 3)
    p = spark.createDataFrame(points, "id long, ts timestamp_ntz, p long")
    s = spark.createDataFrame(spans, "id long, lo timestamp_ntz, hi timestamp_ntz, s long")
    got = windows.in_interval_window(p, s, ["id"], "ts", "lo", "hi", H(6), H(12), width)
    want = sorted(
        (i, k)
        for (a, ts, i) in points for (b, lo, hi, k) in spans
        if a is not None and a == b and ts and hi and lo - H(6) <= ts <= hi + H(12)
    )
    assert sorted((r.p, r.s) for r in got.collect()) == want
    assert len(want) > 50


def test_window_grows_with_its_width(spark):
    points, spans = _random_windows(spark, 4)
    p = spark.createDataFrame(points, "id long, ts timestamp_ntz, p long")
    a = spark.createDataFrame([s[:2] + s[3:] for s in spans], "id long, anchor timestamp_ntz, s long")
    counts = [windows.in_point_window(p, a, ["id"], "ts", "anchor", H(n), H(n)).count() for n in (0, 6, 24, 100)]
    assert counts == sorted(counts) and counts[-1] > counts[1]


def test_shared_columns_are_refused(spark):
    df = spark.createDataFrame([(1, at(1), 2)], "id long, ts timestamp_ntz, x long")
    with pytest.raises(ValueError, match="both sides"):
        windows.in_point_window(df, df.withColumnRenamed("ts", "anchor"), ["id"], "ts", "anchor", H(1), H(1))


def test_bounds(spark):
    m = spark.createDataFrame([(1, at(1)), (1, at(2)), (1, at(2, 0, 0, 1)), (2, at(1)), (3, at(1))], "id long, ts timestamp_ntz")
    b = spark.createDataFrame([(1, at(2)), (2, None)], "id long, b timestamp_ntz")
    assert rows(windows.before_bound(m, b, ["id"], "ts", "b"), "ts") == [(at(1),)]
    assert rows(windows.from_bound(m, b, ["id"], "ts", "b"), "ts") == [(at(2),), (at(2, 0, 0, 1),)]
    assert windows.first_hours(m, b, ["id"], "ts", "b", 0).count() == 2


def test_stay_at_anchor(spark):
    stays = spark.createDataFrame(
        [("covers", 1, at(4), at(6)), ("two hours", 1, at(5, 2), at(7)), ("too late", 1, at(5, 2, 0, 1), at(7)),
         ("at anchor", 1, at(5), at(5, 1)), ("ended", 1, at(3), at(4, 23)), ("other", 2, at(4), at(6)),
         ("open", 1, at(5, 1), None), ("long", 1, at(-400), at(400))],
        "name string, id long, arrive timestamp_ntz, depart timestamp_ntz",
    )
    anchors = spark.createDataFrame([(1, at(5))], "id long, anchor timestamp_ntz")
    got = windows.stay_at_anchor(stays, anchors, ["id"], "arrive", "depart", "anchor")
    assert {r.name: (r.covers, r.hours_after) for r in got.collect()} == {
        "covers": (True, -24.0), "two hours": (False, 2.0), "at anchor": (True, 0.0), "open": (False, 1.0),
        "long": (True, -405 * 24.0),
    }


def test_last_before_any_anchor(spark):
    m = spark.createDataFrame(
        [(1, "a", at(1), 1.0), (1, "a", at(4), 2.0), (1, "a", at(6), 3.0), (1, "b", at(7), 4.0), (2, "a", at(1), 5.0)],
        "id long, lab string, ts timestamp_ntz, x double",
    )
    anchors = spark.createDataFrame([(1, at(3)), (1, at(5))], "id long, anchor timestamp_ntz")
    got = windows.last_before(m, anchors, ["id"], "ts", "anchor", ["id", "lab"])
    assert rows(got, "id", "lab", "ts", "x") == [(1, "a", at(4), 2.0)]


# ---- firsts

def test_first_and_last_of_tied_values(spark):
    df = spark.createDataFrame(
        [(1, at(1), 1, "9"), (1, at(1), 2, "10"), (1, at(2), 3, "5"), (1, None, 9, "99"), (2, None, 4, "a"), (2, None, 5, None),
         (3, at(1), None, None), (3, at(2), 1, "x")],
        "id long, ts timestamp_ntz, code long, v string",
    )
    first = firsts.keep_first(df, ["id"], "ts", {"code": "code", "v": "v"}, time_as="t")
    assert rows(first, "id", "t", "code", "v") == [(1, at(1), 2, "9"), (2, None, 5, "a"), (3, at(1), None, None)]
    last = firsts.keep_last(df, ["id"], "ts", {"v": "v"}, time_as="t")
    assert rows(last, "id", "v") == [(1, "99"), (2, "a"), (3, "x")]
    timed = df.where("ts is not null")
    a = firsts.keep_first(timed, ["id"], "ts", {}, time_as="first").join(
        firsts.keep_last(timed, ["id"], "ts", {}, time_as="last"), "id"
    )
    assert a.where("first > last").isEmpty()


def test_missing_unit_is_its_own_group(spark):
    df = spark.createDataFrame([(1, None, at(2), "1"), (1, "kg", at(1), "2")], "id long, unit string, ts timestamp_ntz, v string")
    got = firsts.keep_first(df, ["id", "unit"], "ts", {"v": "v"})
    assert rows(got, "unit", "v") == [("kg", "2"), (None, "1")]


def test_row_picks_do_not_depend_on_arrival(spark):
    rnd = random.Random(1)
    data = [(rnd.randrange(4), rnd.choice("ab"), at(rnd.randrange(1, 6)), rnd.random()) for _ in range(100)]
    results = []
    for parts in (1, 7):
        rnd.shuffle(data)
        df = spark.createDataFrame(data, "id long, c string, ts timestamp_ntz, x double").repartition(parts)
        results.append((
            rows(firsts.first_row_per_concept(df, "id", "c", "ts", ["x"])),
            rows(firsts.first_row_per_subject(df, "id", "ts", ["x"])),
            rows(firsts.dedupe_first(df, ["id", "ts", "c"], ["x"])),
        ))
    assert results[0] == results[1]
    assert len(results[0][0]) == 8 and len(results[0][1]) == 4


def test_unmatched_rows_count_as_one_subject(spark):
    df = spark.createDataFrame([(1, at(3), "a"), (1, at(2), "b"), (None, at(1), "c"), (None, at(2), "d")],
                               "id long, ts timestamp_ntz, fin string")
    assert rows(cohort.first_anchor(df, "id", "ts", ["fin"]), "id", "fin") == [(1, "b"), (None, "c")]
    assert rows(cohort.first_anchor(df, "id", "ts", ["fin"], drop_null_key=True), "fin") == [("b",)]


def test_extremes_ignore_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (1, 5.0), (2, None)], "id long, x double")
    assert rows(extremes.minmax(df, ["id"], "x")) == [(1, 2.0, 5.0), (2, None, None)]


# ---- reshape

def test_pivot_and_back(spark):
    data = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", None), (3, "b", 4.0)]
    df = spark.createDataFrame(data, "id long, c string, x double")
    wide = reshape.pivot_values(df, ["id"], "c", "x", ["a", "b"], strict=True)
    assert rows(wide) == [(1, 1.0, 2.0), (2, None, None), (3, None, 4.0)]
    back = wide.unpivot(["id"], ["a", "b"], "c", "x").where("x is not null")
    assert rows(back) == [d for d in data if d[2] is not None]


def test_pivot_refuses_repeats(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", None)], "id long, c string, x double")
    with pytest.raises(Exception, match="more than one row per key for a"):
        reshape.pivot_values(df, ["id"], "c", "x", ["a"], strict=True).collect()
    assert rows(reshape.pivot_values(df, ["id"], "c", "x", ["a"])) == [(1, 1.0)]


def test_presence_discovery_and_vocabulary(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None)], "id long, c string")
    assert reshape.discover_values(df, "c") == ["a", "b"]
    with pytest.raises(ValueError, match="too many"):
        reshape.discover_values(df, "c", limit=1)
    many = spark.range(reshape.MOST_COLUMNS + 1).selectExpr("cast(id as string) as c")
    with pytest.raises(ValueError, match="too many"):
        reshape.discover_values(many, "c")
    present = reshape.presence_pivot(df, ["id"], "c", ["a", "b"], prefix="p.").collect()
    assert {(r["id"], r["p.a"], r["p.b"]) for r in present} == {(1, True, None), (2, None, True)}
    assert rows(reshape.presence_pivot(df, ["id"], "c", [])) == [(1,), (2,)]
    assert rows(reshape.vocabulary([(df, "c"), (df.where("id = 1"), "c")])) == [("a",), ("a",), ("b",), (None,)]


def test_outer_assembly_and_stack(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, a string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "id long, b int")
    assert rows(reshape.full_outer([a, b], "id")) == [(1, "x", None), (2, "y", 5), (3, None, 6)]
    assert rows(reshape.assemble(a, [b], "id")) == [(1, "x", None), (2, "y", 5)]
    assert rows(reshape.stack([a, b])) == [
        (1, "x", None), (2, "y", None), (2, None, 5), (3, None, 6)
    ]
    assert reshape.union_distinct([a, a]).count() == 2
    with pytest.raises(ValueError):
        reshape.union_distinct([a, a.select("id")])


# ---- lookups

def test_lookups(spark):
    codes = spark.createDataFrame([(1, "one"), (2, "two")], "code_value long, display string")
    df = spark.createDataFrame([(10, 1, 2), (11, None, 9)], "id long, a long, b long")
    got = lookup.with_display(df, codes, {"a": "a_text", "b": "b_text"})
    assert rows(got) == [(10, 1, 2, "one", "two"), (11, None, 9, None, None)]
    right = spark.createDataFrame([(10, at(1), "old"), (10, at(3), "new")], "id long, ts timestamp_ntz, v string")
    left = spark.createDataFrame([(10, at(2)), (12, at(2))], "id long, anchor timestamp_ntz")
    for least in (10**9, 1):
        early = lookup.outer_before(left, right, ["id"], "ts", "anchor", least)
        assert rows(early, "id", "v") == [(10, "old"), (12, None)]
    for least in (1, 10**9):
        kept = lookup.left_with_condition(left, right, ["id"], F.col("v") == "none", least)
        assert sorted(kept.columns) == sorted({*left.columns, *right.columns})
    assert rows(kept, "id", "v") == [(10, None), (12, None)]


# ---- fill-down and readmissions

@pytest.mark.parametrize("width", [None, dt.timedelta(days=3), dt.timedelta(days=500)])
def test_locf_equals_the_loop(spark, width):
    rnd = random.Random(9)
    data = [
        (rnd.choice([1, 2, None]), rnd.choice([None, at(rnd.randrange(1, 60), rnd.randrange(24))]), i,
         rnd.choice([None, None, i]), rnd.choice([None, f"v{i}"]))
        for i in range(150)
    ]
    df = spark.createDataFrame(data, "p long, ts timestamp_ntz, i long, x long, y string").repartition(5)
    filled = readmit.locf(df, ["p"], "ts", ["i"], ["x", "y"], width)
    assert filled.columns == df.columns
    got = {r.i: (r.x, r.y) for r in filled.collect()}
    want, state = {}, {}
    for p, ts, i, x, y in sorted(data, key=lambda r: (r[1] is None, r[1] or at(1), r[2])):
        old = state.get(p, (None, None))
        state[p] = want[i] = (old[0] if x is None else x, old[1] if y is None else y)
    assert got == want
    again = {r.i: (r.x, r.y) for r in readmit.locf(filled, ["p"], "ts", ["i"], ["x", "y"], width).collect()}
    assert again == got


def test_readmission_rules(spark):
    def visit(p, v, day, index=False, disposition="Home"):
        return (p, v, at(day), at(day) if index else None, disposition)

    visits = [
        visit(1, 10, 1, True), visit(1, 11, 31),  # +30 days
        visit(2, 20, 1, True), visit(2, 21, 32),  # +31 days
        visit(3, 30, 1, True), visit(3, 31, 6, disposition="Cadaver Organ Donor"), visit(3, 32, 7, disposition=None),
        visit(4, 40, 1), visit(4, 41, 5, True),  # before the index visit
        visit(5, 50, 1, True), visit(5, 51, 11, True), visit(5, 52, 16),  # second index resets the clock
        visit(6, 60, 1, True), visit(6, 61, 36),  # 20-day stay, back 15 days after discharge
        visit(7, 70, 1), visit(7, 71, 2),
    ]
    df = spark.createDataFrame(visits, "p long, v long, admit timestamp_ntz, idx timestamp_ntz, disp string")
    for width in (None, dt.timedelta(days=7), dt.timedelta(days=30)):
        got = readmit.readmissions(df, "p", "v", "admit", "idx", "disp", "Cadaver Organ Donor", width=width)
        assert rows(got, "p", "v", "index_id", "readmit_days") == [(1, 11, 10, 30.0), (5, 52, 51, 5.0)]


def test_readmission_clock_may_run_late(spark):
    late = [(1, 10, at(1), at(1, 12), "Home"), (1, 11, at(31, 6), None, "Home"), (1, 12, at(32), None, "Home")]
    df = spark.createDataFrame(late, "p long, v long, admit timestamp_ntz, idx timestamp_ntz, disp string")
    args = ("p", "v", "admit", "idx", "disp", "none")
    for width in (None, dt.timedelta(days=2)):
        assert rows(readmit.readmissions(df, *args, width=width), "v", "readmit_days") == [(11, 29.75)]
    much = [(1, 10, at(1), at(41), "Home"), (1, 11, at(20), None, "Home"), (1, 12, at(45), None, "Home"),
            (1, 13, at(80), None, "Home"), (2, 20, at(1), at(1), "Home"), (2, 21, at(3), at(300), "Home"),
            (2, 22, at(9), None, "Home"), (2, 23, at(310), None, "Home")]
    df = spark.createDataFrame(much, "p long, v long, admit timestamp_ntz, idx timestamp_ntz, disp string")
    for width in (None, dt.timedelta(days=2)):
        assert rows(readmit.readmissions(df, *args, width=width), "v", "readmit_days") == [(12, 4.0), (23, 10.0)]


def test_readmissions_equal_the_loop(spark):
    rnd = random.Random(12)
    data = []
    for v in range(250):
        day = at(rnd.randrange(1, 200), rnd.randrange(24))
        data.append((rnd.choice([1, 1, 2, None]), v, day, day if rnd.random() < 0.2 else None, rnd.choice(["Home", "out", None])))
    df = spark.createDataFrame(data, "p long, v long, admit timestamp_ntz, idx timestamp_ntz, disp string").repartition(4)
    want, clock = [], {}
    for p, v, admit, idx, disp in sorted(data, key=lambda r: (r[2], r[1])):
        if idx:
            clock[p] = (idx, v)
        if p in clock and disp == "Home" and dt.timedelta(0) < admit - clock[p][0] <= dt.timedelta(days=30):
            want.append((v, clock[p][1]))
    for width in (None, dt.timedelta(days=4)):
        got = readmit.readmissions(df, "p", "v", "admit", "idx", "disp", "out", width=width)
        assert sorted((r.v, r.index_id) for r in got.collect()) == sorted(want)


# ---- batches

def test_batches_and_row_index(spark):
    ids = [f"{i:04d}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:50] + [None]], "fin string").repartition(6)
    got = sorted(batches.batch_ids(df, "fin").collect(), key=lambda r: r.batch)
    assert [r.n_ids for r in got] == [75, 75, 50]
    assert [r.ids for r in got] == [";".join(ids[i:i + 75]) for i in (0, 75, 150)]
    one = batches.batch_ids(df, "fin", n=1000, sep=",").collect()
    assert one[0].ids == ",".join(ids)
    numbered = batches.with_row_index(df.where("fin is not null").distinct(), [F.col("fin").desc()])
    assert {r.fin: r.row_index for r in numbered.collect()} == {f: 199 - i for i, f in enumerate(ids)}
    assert batches.batch_ids(df.limit(0), "fin").count() == 0


def hot_tables(spark, n=3000):
    """A left table, and a right table of which one key holds a third and another a sixth; null keys on both sides."""
    key = "case when id % 3 = 0 then 7 when id % 6 = 1 then 5 when id % 100 = 2 then null else id % 400 + 20 end"
    right = spark.range(n).selectExpr(f"cast({key} as int) as k", "id as r", "id % 50 as ts")
    left = spark.range(60).selectExpr("case when id < 8 then 7 when id = 9 then null else id end as k", "id as l", "id % 7 as anchor")
    return left, right


def test_frequent_keys_are_found_and_dealt_evenly(spark):
    left, right = hot_tables(spark)
    assert sorted(lookup.frequent_keys(right, ["k"], 400).values()) == [500, 1000]
    assert lookup.frequent_keys(right, ["k"], 5000) == {}
    assert lookup.frequent_keys(right.limit(0), ["k"], 1) == {}
    _, rest, _, _, dealt = lookup._split(left, right, ["k"], 100)
    sizes = [r["count"] for r in dealt.groupBy("k", "__slice").count().collect()]
    assert len(sizes) == 15 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert rest.where("k in (5, 7)").isEmpty() and rest.count() + sum(sizes) == 3000


@pytest.mark.parametrize("least", [10, 100, 10**9])
def test_outer_joins_with_frequent_keys_equal_the_plain_join(spark, least):
    left, right = hot_tables(spark, 1200)
    wanted = F.col("r") % 4 != 3
    got = lookup.left_with_condition(left, right, ["k"], wanted, least)
    want = left.join(right.where(wanted), ["k"], "left")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = lookup.outer_before(left, right, ["k"], "ts", "anchor", least)
    named = right.withColumnRenamed("k", "k2")
    want = left.join(named, (F.col("k") == F.col("k2")) & (F.col("ts") < F.col("anchor")), "left").drop("k2")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_totals_over_blocks(spark):
    rows = [("a" if i % 3 else "b", i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(5)
    got = {(r.k, r.i): r.upto_n for r in batches.running_totals(df, ["k"], ["i"], ["n"], block=7).collect()}
    sums = {}
    for k, i, n in rows:
        sums[k] = sums.get(k, 0) + n
        assert got[k, i] == sums[k]
