"""Plan shapes that have to hold at any size."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from anchorline.functions.clean import current_version
from anchorline.operators import cohort, firsts, index, windows
from anchorline.plans import analysis
from anchorline.registry import all_queries
from anchorline.sources.warehouse import SCHEMAS, load

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()
# Queries that end in one row anyway (a summary of the whole table), or use bounds of the whole table
ONE_ROW = {
    "balance_summary", "common_support", "greedy_match", "matched_sample", "match_balance", "match_counts",
    "customer_match_balance", "customer_match_pairs", "customer_match_sample", "matched_cohort", "match_pairs",
    "balance_distances", "write_datasets", "load_warehouse",  # one row per data set, or per column of a table
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ONE_ROW))
def test_no_pairing_of_everything_and_no_single_task(unbroadcast, name):
    text = plan(QUERIES[name](unbroadcast, FOLDER))
    assert "NestedLoop" not in text and "Cartesian" not in text
    lines = text.split("\n")  # the few levels of a window join are gathered from partial sets
    for line, below in zip(lines, lines[1:], strict=False):
        assert "SinglePartition" not in line or "partial_collect_set(__level" in below
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_version_and_codes_reach_the_scan(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    events = load(spark, str(tmp_path)).clinical_event
    text = plan(events.where(current_version() & events.event_cd.isin([1, 2])).select("event_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: (.*)", text)
    assert "GreaterThan(valid_until_dt_tm" in pushed[1] and "In(event_cd" in pushed[1]
    assert "result_val" not in pushed[2]


def test_first_rows_are_reduced_before_the_shuffle(spark):
    df = spark.read.parquet(f"{FOLDER}/events.parquet")
    text = plan(firsts.first_row_per_subject(df, "user_id", "ts", ["event_id"]))
    assert text.index("partial_min") > text.index("Exchange") > text.index("min(")
    assert "Window" not in text


def test_windows_join_on_cells_and_small_anchors_are_broadcast(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "ts", "value")
    anchors = spark.createDataFrame([(1, dt.datetime(2024, 1, 5))], "user_id long, anchor timestamp_ntz")
    hours = dt.timedelta(hours=6)
    text = plan(windows.in_point_window(events, anchors.limit(1), ["user_id"], "ts", "anchor", hours, hours))
    assert re.search(r"BroadcastHashJoin \[user_id#\d+L, __level#\d+, __cell#\d+L\]", text)


@pytest.mark.parametrize("width", [dt.timedelta(minutes=1), dt.timedelta(hours=1), dt.timedelta(days=30)])
def test_an_interval_of_any_length_takes_a_few_rows(spark, width):
    start = dt.datetime(2024, 1, 5, 3, 2, 1)
    lengths = [dt.timedelta(0), dt.timedelta(seconds=1), width, 3 * width, dt.timedelta(days=400), dt.timedelta(days=73_000)]
    df = spark.createDataFrame([(i, start, start + n) for i, n in enumerate(lengths)], "i int, lo timestamp_ntz, hi timestamp_ntz")
    level = windows._level(F.col("lo"), F.col("hi"), width)
    cells = df.withColumn("level", level).withColumn("n", windows._cell(F.col("hi"), width, F.col("level")) - windows._cell(
        F.col("lo"), width, F.col("level")) + 1)
    assert cells.agg(F.max("n")).first()[0] <= 3
    points = spark.createDataFrame([(start + n,) for n in lengths], "ts timestamp_ntz").withColumn("k", F.lit(1))
    got = windows.interval_join(points, df.withColumn("k", F.lit(1)), ["k"], "ts", F.col("lo"), F.col("hi"), width)
    assert got.count() == sum(a <= b for a in lengths for b in lengths)


def test_study_set_restricts_before_the_first_aggregate(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr(
        "user_id as encntr_id", "ts as event_ts", "event_type as event", "value as result"
    )
    include = spark.range(20).selectExpr("id as encntr_id", "cast(id as string) as fin")
    text = plan(analysis.admit_values(include, events, events, events, events, ["click"], ["view"]))
    for part in text.split("FileScan")[:-1]:
        assert "LeftSemi" in part[part.rindex("partial"):]  # plans list what runs later first


def test_index_interval_scans_once(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    text = plan(index.index_interval(events, ["user_id"], "event_type", "ts", "signup", "purchase"))
    assert text.count("FileScan") == 1 and text.count(" Exchange ") == 1
    assert "In(event_type" in text


def test_restrict_is_a_semi_join(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert "LeftSemi" in plan(cohort.restrict(events, events.select("user_id"), "user_id"))
