"""Extraction rules, one row set per rule."""

import datetime as dt

import pytest

from anchorline.functions import concepts as C
from anchorline.operators.cohort import cohort_from_list
from anchorline.plans import extraction as E
from anchorline.sources.warehouse import SCHEMAS, Tables, load

OPEN, CLOSED = dt.datetime(2100, 12, 31), dt.datetime(2020, 1, 1)


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


class Chart:
    """Builds warehouse rows; encounter n belongs to person 100 + n and account 'F<n>'."""

    def __init__(self):
        self.rows = {name: [] for name in SCHEMAS}
        self.next_event = 1
        codes = {c: t for s in C.CONCEPT_SETS.values() for c, t in s.items()}
        codes |= {170: "kg", 171: "lb", 1: "White", 2: "Male", C.INDEX_START: "Start", C.INDEX_STOP: "Stop",
                  C.WEIGHT: "Weight", 7: "CPR Medication x", 8: "Other CPR Medication"}
        self.rows["code_value"] = list(codes.items())

    def encounter(self, n, reg=at(1), disch=at(30), birth=dt.datetime(1980, 1, 1), alias_type=C.ACCOUNT_ALIAS):
        self.rows["encntr_alias"].append((n, f"F{n}", alias_type))
        self.rows["encounter"].append((n, 100 + n, reg, disch, "reason"))
        self.rows["person"].append((100 + n, birth, 1, 2))

    def event(self, n, code, ts, value=None, unit=None, cls=C.CLASS_NUMERIC, parent=None, valid=OPEN, person=None):
        event_id, self.next_event = self.next_event, self.next_event + 1
        self.rows["clinical_event"].append(
            (event_id, parent, n, person or 100 + n, code, cls, ts, value, unit, valid)
        )
        return event_id

    def index(self, n, parent, start=None, stop=None, valid=OPEN):
        for code, ts in ((C.INDEX_START, start), (C.INDEX_STOP, stop)):
            if ts:
                event_id = self.event(n, code, ts, cls=C.CLASS_DATE, parent=parent)
                self.rows["ce_date_result"].append((event_id, ts, valid))

    def order(self, n, order_id, start, *details, catalog=C.RESUSCITATION_ORDERS[0]):
        self.rows["orders"].append((order_id, n, catalog, start))
        for value, updated, *meaning in details:
            self.rows["order_detail"].append((order_id, *(meaning or [C.RESUSCITATION_DETAIL]), value, updated))

    def tables(self, spark):
        return Tables(lambda name: spark.createDataFrame(self.rows[name], SCHEMAS[name]))


@pytest.fixture
def chart():
    return Chart()


def ask(spark, query, chart, *accounts):
    return query(E.Study(cohort_from_list(spark, accounts), chart.tables(spark)), zone="UTC").collect()


def intervals(spark, chart, *accounts):
    rows = ask(spark, E.code_dates, chart, *accounts)
    return sorted(((r[0], r[1], r[2], r[3]) for r in rows), key=str)


def test_only_the_current_date_result_counts(spark, chart):
    chart.encounter(1)
    chart.index(1, 10, start=at(2, 5), valid=CLOSED)
    chart.index(1, 10, start=at(2, 6))
    assert intervals(spark, chart, "F1") == [("F1", 10, at(2, 6), None)]


def test_no_index_event_gives_one_empty_row(spark, chart):
    chart.encounter(1)
    chart.encounter(2, alias_type=5)
    assert intervals(spark, chart, "F1", "F2", "F9") == [("F1", None, None, None)]


def test_several_starts_and_stops(spark, chart):
    chart.encounter(1)
    chart.index(1, 10, at(2, 6), at(2, 7))
    chart.index(1, 10, at(2, 5), at(2, 8))
    chart.index(1, 11, at(3, 1))
    assert intervals(spark, chart, "F1") == [("F1", 10, at(2, 5), at(2, 8)), ("F1", 11, at(3, 1), None)]


def test_person_must_match_and_missing_parent_has_no_times(spark, chart):
    chart.encounter(1)
    event_id = chart.event(1, C.INDEX_START, at(2), cls=C.CLASS_DATE, parent=10, person=999)
    chart.rows["ce_date_result"].append((event_id, at(2), OPEN))
    chart.index(1, None, start=at(3))
    assert intervals(spark, chart, "F1") == [("F1", None, None, None)]


def test_parent_shared_by_two_encounters(spark, chart):
    for n in (1, 2):
        chart.encounter(n)
    chart.index(1, 10, start=at(2), stop=at(4))
    chart.index(2, 10, start=at(3), stop=at(5))
    both = [(f, 10, s, at(5)) for f in ("F1", "F2") for s in (at(2), at(3))]
    assert intervals(spark, chart, "F1", "F2") == sorted(both, key=str)


def test_daylight_saving(spark, chart):
    chart.encounter(1)
    chart.index(1, 10, start=dt.datetime(2024, 3, 10, 8, 30), stop=dt.datetime(2024, 3, 10, 7, 30))
    row = E.code_dates(E.Study(cohort_from_list(spark, ["F1"]), chart.tables(spark))).first()
    assert (row.code_start_datetime, row.code_stop_datetime) == (
        dt.datetime(2024, 3, 10, 3, 30), dt.datetime(2024, 3, 10, 1, 30)
    )


def test_window_edges_and_missing_stop(spark, chart):
    chart.encounter(1)
    chart.encounter(2)
    chart.index(1, 10, start=at(5, 12), stop=at(5, 13))
    chart.index(2, 20, start=at(5, 12))
    hct = 31806
    for ts in (at(5, 6), at(5, 5, 59, 59), at(6, 1), at(6, 1, 0, 1)):
        chart.event(1, hct, ts, "30", 171)
    chart.event(1, hct, at(5, 12), "old", valid=CLOSED)
    chart.event(1, hct, at(5, 12), "wrong class", cls=C.CLASS_MED)
    chart.event(1, 30724, at(5, 12), "wrong code")
    chart.event(2, hct, at(5, 12), "31")
    rows = ask(spark, E.peri_event_vitals, chart, "F1", "F2")
    assert sorted(tuple(r) for r in rows) == [
        ("F1", at(5, 6), "Hct", "30", "lb"), ("F1", at(6, 1), "Hct", "30", "lb")
    ]


def test_electrolytes_one_day_either_side(spark, chart):
    chart.encounter(1)
    chart.index(1, 10, start=at(5, 12), stop=at(5, 13))
    for ts in (at(4, 12), at(4, 11, 59), at(6, 13), at(6, 13, 1)):
        chart.event(1, 32170, ts, "4")
    rows = ask(spark, E.electrolytes_24h, chart, "F1")
    assert sorted(r.lab_datetime for r in rows) == [at(4, 12), at(6, 13)]
    assert {(r.lab, r.result_units) for r in rows} == {("Potassium Lvl", None)}


def test_meds_inside_the_interval(spark, chart):
    chart.encounter(1)
    chart.index(1, 10, start=at(5, 12), stop=at(5, 13))
    for ts, dose in ((at(5, 12), 1.0), (at(5, 13), 2.0), (at(5, 13, 1), 3.0)):
        event_id = chart.event(1, 37556849, ts, cls=C.CLASS_MED)
        chart.rows["ce_med_result"].append((event_id, dose, 170, None, None, None))
    chart.event(1, 37556849, at(5, 12), cls=C.CLASS_MED)  # no dose charted
    rows = ask(spark, E.event_meds, chart, "F1")
    assert sorted((r.dose, r.medication, r.dose_units) for r in rows) == [
        (1.0, "EPINephrine", "kg"), (2.0, "EPINephrine", "kg")
    ]


def test_events_under_the_parent(spark, chart):
    chart.encounter(1)
    chart.index(1, 10, start=at(5, 12))
    kept = chart.event(1, 7, at(5, 12), "given", cls=1, parent=10, valid=CLOSED)
    chart.event(1, 8, at(5, 12), "not at the start of the name", cls=1, parent=10)
    chart.event(1, 7, at(5, 12), "other parent", cls=1, parent=11)
    old = chart.event(1, C.INDEX_STOP, at(5), "date", cls=C.CLASS_DATE, parent=10)
    chart.rows["ce_date_result"].append((old, at(6), CLOSED))
    rows = {r.event_id: (r.event, r.result_val, r.result_datetime) for r in ask(spark, E.cpr_events, chart, "F1")}
    assert rows == {
        1: ("Start", None, at(5, 12)), kept: ("CPR Medication x", "given", None), old: ("Stop", "date", None)
    }


def test_status_is_the_last_before_the_first_index(spark, chart):
    chart.encounter(1)
    chart.encounter(2)
    chart.index(1, 10, start=at(5))
    chart.index(1, 11, start=at(8))
    chart.index(2, 20, start=at(5))
    chart.order(1, 1, at(2), ("Full", at(2)), ("DNR", at(3)), ("A tie", at(3)), ("late", at(5)), ("x", at(4), 1))
    chart.order(1, 2, at(6), ("after", at(4)))
    chart.order(1, 3, at(2), ("other order", at(4)), catalog=1)
    rows = E.code_status(E.Study(cohort_from_list(spark, ["F1", "F2"]), chart.tables(spark))).collect()
    assert [tuple(r) for r in rows] == [(1, "DNR")]


def test_demographics(spark, chart):
    chart.encounter(1, reg=at(1, 12), disch=at(3), birth=dt.datetime(1980, 1, 2))
    chart.encounter(2, disch=None)
    chart.event(1, C.WEIGHT, at(2), "9", 170)
    chart.event(1, C.WEIGHT, at(2), "10", 170)
    chart.event(1, C.WEIGHT, at(1), "150", 171)
    chart.event(1, C.WEIGHT, at(3), "at discharge", 170)
    chart.event(2, C.WEIGHT, at(2), "70", 170)
    rows = {r.fin: r for r in ask(spark, E.demographics, chart, "F1", "F2")}
    first = rows["F1"]
    assert (first.los, first.age, first.race, first.sex) == (1.5, 43, "White", "Male")
    assert (first.weight, first.code_status, first.admit_reason) == ("9", None, "reason")
    assert (rows["F2"].weight, rows["F2"].los) == (None, None)


def test_baseline_first_values(spark, chart):
    chart.encounter(1)
    chart.encounter(2, disch=None)
    chart.event(1, 30100, at(2), "9", 170)
    chart.event(1, 119822536, at(2), "10", 170)  # same time: the larger code and the larger text, separately
    chart.event(1, 30100, at(1), "37")  # no unit: a group of its own
    chart.event(1, 30100, None, "99", 170)
    chart.event(1, 32170, at(4), "4", 170)
    chart.event(1, 32619, at(5), "140", 170)
    chart.event(1, 32619, at(6), "141", 170)
    chart.event(2, 32170, at(4), "4", 170)
    rows = ask(spark, E.baseline_values, chart, "F1", "F2")
    assert sorted((r.event, r.event_datetime, r.event_result, r.result_units or "") for r in rows) == [
        ("Potassium Lvl", at(4), "4", "kg"), ("Sodium Lvl", at(5), "140", "kg"), ("Temperature", at(1), "37", ""),
        ("Temperature Oral", at(2), "9", "kg"),
    ]


def test_tables_are_read_with_declared_schemas(spark, chart, tmp_path):
    chart.encounter(1)
    chart.index(1, 10, start=at(5))
    tables = chart.tables(spark)
    for name in SCHEMAS:
        getattr(tables, name).write.parquet(f"{tmp_path}/{name}")
    rows = E.code_dates(E.Study(cohort_from_list(spark, ["F1"]), load(spark, str(tmp_path))), zone="UTC").collect()
    assert [r.code_start_datetime for r in rows] == [at(5)]


def test_all_queries_of_a_study_scan_the_index_once(spark, chart, monkeypatch):
    chart.encounter(1)
    chart.index(1, 900, at(5), at(6))
    scans = []
    monkeypatch.setattr(E, "index_events", lambda *a, f=E.index_events: scans.append(1) or f(*a))
    study = E.Study(cohort_from_list(spark, ["F1"]), chart.tables(spark))
    for query in (E.code_dates, E.code_status, E.cpr_events, E.electrolytes_24h, E.peri_event_vitals, E.event_meds,
                  E.demographics, E.baseline_values):
        query(study)
    assert len(scans) == 1
