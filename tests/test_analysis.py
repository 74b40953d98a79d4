import datetime as dt

import pytest
from pyspark.sql import functions as F

from anchorline.functions import concepts as C
from anchorline.plans import analysis as A
from anchorline.plans import matched as P


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


MEASURE = "encntr_id long, event_ts timestamp_ntz, event string, result string"


@pytest.fixture
def include(spark):
    return spark.createDataFrame(
        [(1, "F1", at(10)), (2, "F2", at(10))], "encntr_id long, fin string, code_ts timestamp_ntz"
    )


def test_anchors_and_study_set(spark):
    listed = spark.createDataFrame(
        [("F1", at(3), at(1, 7)), ("F1", at(2), at(1, 8)), ("F2", at(2), at(1)), ("F8", at(5), at(1)), ("F9", at(4), at(1))],
        "fin string, date timestamp_ntz, time timestamp_ntz",
    )
    ids = spark.createDataFrame([("F1", 1), ("F2", 2)], "fin string, encntr_id long")
    once = A.anchors_from_list(listed, ids)
    assert rows(once, "encntr_id", "fin", "code_ts") == [
        (1, "F1", at(2, 8)), (2, "F2", at(2)), (None, "F9", at(4))
    ]
    assert A.anchors_from_list(listed, ids, one_per_subject=False).count() == 5
    demo = spark.createDataFrame(
        [(1, "Main"), (2, "SE Southeast"), (3, None)], "encntr_id long, facility string"
    )
    assert rows(A.study_set(once, demo), "fin") == [("F1",)]


def test_event_groups(spark, include):
    data = [
        (1, at(9, 0), "systolic blood pressure", "39"), (1, at(11, 0), "systolic blood pressure", "40"),
        (1, at(11, 0, 0, 1), "systolic blood pressure", "50"), (1, at(10), "arterial systolic bp 1", "300"),
        (1, at(10), "hgb", "<5"), (1, at(9, 23), "temperature oral", None), (1, at(10), "spo2 percent", "0"),
        (1, at(10), "spo2 percent", "5"), (1, at(10), "respiratory rate", "3"), (1, at(10), "weight", "70"),
        (9, at(10), "hgb", "7"),
    ]
    got = A.event_groups(spark.createDataFrame(data, MEASURE), include)
    assert rows(got, "event_group", "event_ts", "result", "pre_code", "censor_low") == [
        ("hgb", at(10), None, False, True), ("rr", at(10), 3.0, False, False), ("sbp", at(11), 40.0, False, False),
        ("spo2", at(10), 5.0, False, False), ("temp", at(9, 23), None, True, None),
    ]
    twice = include.unionByName(include.withColumn("code_ts", F.expr("code_ts + interval 1 hour")))
    assert A.event_groups(spark.createDataFrame(data, MEASURE), twice).where("event_group = 'hgb'").count() == 2


def test_admit_values(spark, include):
    df = lambda *r: spark.createDataFrame(list(r), MEASURE)
    got = A.admit_values(
        include,
        df((1, at(2), "temperature", "36"), (1, at(1), "temperature oral", "37"), (7, at(1), "temperature", "39")),
        df((1, at(1), "hgb", "9"), (1, at(1), "hgb", "8"), (1, at(2), "hct", "30"), (1, None, "hct", "1")),
        df((1, at(1), "apical heart rate", "90")),
        df((1, at(3), "glasgow coma score", "15"), (1, at(2), "eye opening", "1")),
    )
    assert got.columns == ["fin", "temperature", "hct", "hgb", "apical heart rate", "gcs"]
    assert rows(got) == [("F1", 37.0, 30.0, 8.0, 90.0, 15.0), ("F2", None, None, None, None, None)]


def test_med_exposure(spark, include):
    meds = spark.createDataFrame(
        [(1, at(9), "amiodarone"), (1, at(10), "lidocaine"), (1, at(11), "potassium chloride"), (1, at(9), "dopamine"),
         (1, at(11), "x potassium"), (1, at(11), "aspirin"), (5, at(11), "dopamine")],
        "encntr_id long, med_ts timestamp_ntz, med string",
    )
    got = A.med_exposure(include, meds)
    assert got.columns[:3] == ["fin", "pre.amiodarone", "pre.lidocaine"]
    assert set(got.columns) == {"fin", "pre.amiodarone", "pre.lidocaine", *C.EVENT_MEDS, "potassium chloride"}
    found = {r.fin: {c for c in got.columns if r[c] is True} for r in got.collect()}
    assert found == {"F1": {"pre.amiodarone", "lidocaine", "potassium chloride"}, "F2": set()}
    assert all(r[c] is not None for r in got.collect() for c in got.columns)


def test_series_and_peri_code(spark, include):
    data = [
        (1, at(10, 12), "hgb", "9"), (1, at(10, 12), "hgb", "8"), (1, at(10, 12), "hct", "30"),
        (1, at(9, 18), "hct", "31"), (1, at(9, 17, 59), "hct", "32"), (1, at(10, 12, 0, 1), "hct", "33"),
    ]
    df = spark.createDataFrame(data, MEASURE)
    assert rows(A.wide_series(include, df)) == [
        ("F1", at(10, 12), False, 30.0, 8.0), ("F1", at(9, 18), True, 31.0, None)
    ]
    assert A.peri_code(include, df).count() == 4


def test_admit_minmax(spark, include):
    demo = spark.createDataFrame([(1, at(9), "Main"), (2, at(9), "Main")], "encntr_id long, admit_ts timestamp_ntz, facility string")
    df = spark.createDataFrame(
        [(1, at(8), "hgb", "5"), (1, at(10), "hgb", "9"), (1, at(10, 0, 1), "hgb", "99"), (1, at(9), "hct", "n/a")], MEASURE
    )
    assert rows(A.admit_minmax(include, demo, df)) == [
        ("F1", "hct", None, None), ("F1", "hgb", 5.0, 9.0), ("F2", None, None, None)
    ]
    assert rows(A.admit_minmax(include, demo, df, by_concept=False)) == [("F1", 5.0, 9.0), ("F2", None, None)]


def test_location_and_cut_off(spark, include):
    stays = spark.createDataFrame(
        [(1, "a", at(9), at(11)), (1, "b", at(9), at(13)), (1, "c", at(9), None)],
        "encntr_id long, unit string, arrive_ts timestamp_ntz, depart_ts timestamp_ntz",
    )
    assert rows(A.location_at_event(include, stays, at(12)), "unit", "code", "time_code") == [("a", True, -24.0)]


def test_labs_before_and_during(spark):
    labs = spark.createDataFrame(
        [("F1", 1, at(1), "ph", 7.1), ("F1", 1, at(2), "ph", 7.2), ("F1", 1, at(1), "po2", 80.0), ("F1", 1, at(3), "ph", 7.3),
         ("F1", 1, at(4), "ph", 7.4), ("F1", 1, at(5), "ph", 7.5)],
        "fin string, encntr_id long, event_ts timestamp_ntz, event string, result double",
    )
    events = spark.createDataFrame([("F1", at(3), at(4))], "fin string, code_start timestamp_ntz, code_end timestamp_ntz")
    both = A.labs_before_during(labs, events)
    assert rows(both["labs_prior"]) == [("F1", at(1), None, 80.0), ("F1", at(2), 7.2, None)]
    assert rows(both["labs_during"]) == [("F1", at(3), 7.3, None), ("F1", at(4), 7.4, None)]
    twice = labs.unionByName(labs)
    with pytest.raises(Exception, match="more than one row per key"):
        A.labs_during(twice, events, ["ph"]).collect()
    assert A.labs_during(twice, events, ["ph"], strict=False).count() == 2


def test_study_tables(spark, include):
    demo = spark.createDataFrame(
        [(1, 50, "M", "W", 3.0, "Home", at(9), at(20), "Main"), (2, 60, "F", "W", 4.0, "Home", at(9), at(20), None)],
        "encntr_id long, age int, gender string, race string, length_stay double, disposition string, "
        "admit_ts timestamp_ntz, discharge_ts timestamp_ntz, facility string",
    )
    visits = spark.createDataFrame(
        [(1, 101, at(9), "Inpatient", "Home", "Main"), (5, 101, at(25), "Inpatient", "Home", "East"),
         (6, 101, at(26), "Outpatient", "Home", "East"), (7, 101, at(27), "Inpatient", "Cadaver Organ Donor", "East")],
        "encntr_id long, person_id long, admit_ts timestamp_ntz, visit_type string, disposition string, facility string",
    )
    m = lambda *r: spark.createDataFrame(list(r), MEASURE)
    measures = {
        "vitals": m((1, at(9), "apical heart rate", "90")), "temps": m((1, at(9), "temperature", "37")),
        "labs": m((1, at(10), "hgb", "9")), "gcs": m((1, at(9), "glasgow coma score", "15")),
        "weights": m((1, at(9, 1), "weight", "81"), (1, at(9), "weight", "80"), (1, at(8), "height", "180")),
    }
    meds = spark.createDataFrame([(1, at(10), "dopamine")], "encntr_id long, med_ts timestamp_ntz, med string")
    tables = A.study_tables(include, demo, visits, include.select("encntr_id", "fin"), measures, meds)
    assert list(tables) == ["patients", "admit_values", "meds", "vitals", "temps", "labs"]
    assert rows(tables["patients"], "fin", "weight", "readmit_facility", "readmit_days") == [("F1", 80.0, "East", 16.0)]
    assert all(df.count() >= 1 for n, df in tables.items() if n not in ("vitals", "temps"))
    extremes = A.minmax_tables(include, demo, measures)
    assert rows(extremes["gcs"]) == [("F1", 15.0, 15.0), ("F2", None, None)]


def test_matched_cohort_from_a_sheet(spark):
    day = dt.date(2018, 1, 13)
    sheet = spark.createDataFrame(
        [(124, "A", 1.0, day, at(1, 10), 1, dt.date(2018, 1, 14), at(1, 10, 30)),
         (124, "B", 1.0, dt.date(2018, 2, 1), at(1, 10), 0, dt.date(2018, 2, 1), at(1, 10, 20)),
         (1, "C", 1.0, day, at(1, 10), None, day, at(1, 9))],
        "id long, fin string, cci double, code_start_date date, code_start_time timestamp_ntz, ca_given int, "
        "code_end_date date, code_end_time timestamp_ntz",
    )
    got = rows(P.matching_features(sheet, P.end_date_rules(spark)))
    assert got == [("A", True, 1.0, 30.0), ("B", False, 1.0, 20.0), ("C", None, 1.0, -60.0)]


def test_matched_cohort(spark):
    data = [(f"F{i:03d}", i % 4 == 0, float(i * 7 % 11), float(i * 13 % 47)) for i in range(120)]
    features = spark.createDataFrame(data, "fin string, ca_given boolean, cci double, code_duration double")
    out = P.matched_cohort(features)
    pairs = [tuple(r) for r in out["pairs"].collect()]
    assert len(pairs) == 30 and len({c for _, c in pairs if c}) == sum(c is not None for _, c in pairs)
    n = sum(c is not None for _, c in pairs)
    assert out["matched"].count() == 2 * n
    counts = {r.units: (r.treated, r.control) for r in out["counts"].collect()}
    assert counts["all"] == (30, 90) and counts["matched"] == (n, n)
    assert counts["unmatched"][0] + counts["discarded"][0] == 30 - n
    balance = {(r["sample"], r.variable): r for r in out["balance"].collect()}
    assert set(balance) == {(s, v) for s in ("all", "matched") for v in ("distance", "cci", "code_duration")}
    gap = lambda s: abs(balance[(s, "distance")].mean_diff)
    assert gap("matched") <= gap("all")
