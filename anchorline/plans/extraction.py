"""Extraction queries on the clinical warehouse: account numbers in, one table out.

All queries of one id list share a `Study`. It writes the cohort, its index groups and the complete intervals
once, when the first query asks for them; that takes a scan of the event table, and runs while the query is built.
These tables are small next to the event table, and as tables their size is known when the rest is planned: Spark
then broadcasts them if they are small enough and scans the event table without a shuffle, else it joins by sort
and merge.
"""

from __future__ import annotations

from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions import concepts as C
from anchorline.functions.clean import concept_or_class, current_version, in_concepts
from anchorline.functions.times import SITE_ZONE, elapsed, to_local, whole_years
from anchorline.operators.cohort import attach, resolve_cohort
from anchorline.operators.firsts import keep_first, keep_last
from anchorline.operators.index import first_index, index_events, index_interval, index_interval_outer
from anchorline.operators.lookup import sibling_events, with_display
from anchorline.operators.windows import before_bound, in_interval_window
from anchorline.session import stable
from anchorline.sources.warehouse import Tables

_SUBJECT = ["encntr_id", "person_id"]


def _charted(tables: Tables, event_class: int, codes, *columns: str, extra: Column | None = None) -> DataFrame:
    """Current rows of one class and code list; all conditions reach the scan."""
    keep = (F.col("event_class_cd") == F.lit(event_class)) & in_concepts("event_cd", codes) & current_version()
    if extra is not None:
        keep = keep & extra
    return tables.clinical_event.where(keep).select(*_SUBJECT, "event_cd", "event_end_dt_tm", *columns)


class Study:
    """One id list on one warehouse, for all queries on it."""

    def __init__(self, ids: DataFrame, tables: Tables):
        self.ids, self.tables = ids, tables

    @cached_property
    def cohort(self) -> DataFrame:
        """Encounters of the listed accounts, with admission, discharge and reason."""
        facts = ["reg_dt_tm", "disch_dt_tm", "reason_for_visit"]
        return stable(resolve_cohort(self.ids, self.tables.encntr_alias, self.tables.encounter, extra=facts))

    @cached_property
    def members(self) -> DataFrame:
        return self.cohort.select(*_SUBJECT, "alias").distinct()

    @cached_property
    def groups(self) -> DataFrame:
        """Start and stop per (encounter, parent); the event table is scanned once for it."""
        events = index_events(self.members, self.tables.clinical_event, self.tables.ce_date_result)
        return stable(
            index_interval(
                events, ["encntr_id", "parent_event_id"], "event_cd", "result_dt_tm", C.INDEX_START, C.INDEX_STOP
            )
        )

    @cached_property
    def intervals(self) -> DataFrame:
        """Per cohort member and index group its interval, in warehouse (UTC) time; outer."""
        return index_interval_outer(self.members, self.groups, "encntr_id", "parent_event_id")

    @cached_property
    def complete(self) -> DataFrame:
        """The intervals with both ends: the anchors of the time windows, read twice by each window join."""
        return stable(
            self.intervals.where("start_ts is not null and stop_ts is not null")
            .select("alias", *_SUBJECT, "start_ts", "stop_ts").distinct()
        )


def code_dates(study: Study, zone: str = SITE_ZONE) -> DataFrame:
    """Index interval per subject in site time; subjects without an index event keep one row."""
    return study.intervals.select(
        F.col("alias").alias("fin"), F.col("parent_event_id").alias("code_event_id"),
        to_local("start_ts", zone).alias("code_start_datetime"),
        to_local("stop_ts", zone).alias("code_stop_datetime"),
    ).distinct()


def _status_before(study: Study) -> DataFrame:
    """Last resuscitation status ordered and updated before the first index event. Subjects without
    such an order are not listed."""
    first = first_index(study.groups, "encntr_id")
    placed = study.tables.orders.where(in_concepts("catalog_cd", C.RESUSCITATION_ORDERS)).select(
        "encntr_id", "order_id", "current_start_dt_tm"
    )
    details = study.tables.order_detail.where(F.col("oe_field_meaning_id") == F.lit(C.RESUSCITATION_DETAIL)).select(
        "order_id", "oe_field_display_value", "updt_dt_tm"
    )
    before = before_bound(placed, first, ["encntr_id"], "current_start_dt_tm", "first_start_ts")
    return keep_last(
        before.join(details, "order_id").where("updt_dt_tm < first_start_ts"),
        ["encntr_id"], "updt_dt_tm", {"code_status": "oe_field_display_value"},
    )


def code_status(study: Study) -> DataFrame:
    """Last resuscitation status before the first index event."""
    return _status_before(study)


def cpr_events(study: Study, zone: str = SITE_ZONE) -> DataFrame:
    """Everything charted under an index event that is a date or a charted medication. The events are
    not reduced to their current version; the date result is, inside the outer join."""
    tables = study.tables
    groups = study.groups.where(F.col("parent_event_id").isNotNull())
    index = study.members.join(groups, "encntr_id").select("alias", "parent_event_id").distinct()
    events = tables.clinical_event.select("parent_event_id", "event_id", "event_cd", "event_class_cd", "result_val")
    names = tables.code_value.select(F.col("code_value").alias("event_cd"), F.col("display").alias("event"))
    dates = tables.ce_date_result.where(current_version()).select("event_id", "result_dt_tm")
    charted = (
        sibling_events(index, events, "parent_event_id").join(names, "event_cd")
        .where(concept_or_class("event", C.CHARTED_MEDICATION_PATTERN, "event_class_cd", C.CLASS_DATE))
    )
    return charted.join(dates, "event_id", "left").select(
        F.col("alias").alias("fin"), F.col("parent_event_id").alias("code_event_id"), "event_id", "event",
        "result_val", to_local("result_dt_tm", zone).alias("result_datetime"),
    ).distinct()


def _around_index(study: Study, measures: DataFrame, before: timedelta, after: timedelta,
                  width: timedelta = timedelta(days=1)) -> DataFrame:
    """Measures of the cohort from start - before to stop + after; incomplete intervals have no window."""
    return in_interval_window(
        measures, study.complete, _SUBJECT, "event_end_dt_tm", "start_ts", "stop_ts", before, after, width
    )


def _measured(study: Study, codes, before: timedelta, after: timedelta, prefix: str,
              zone: str) -> DataFrame:
    measures = _charted(study.tables, C.CLASS_NUMERIC, codes, "result_val", "result_units_cd")
    near = _around_index(study, measures, before, after)
    named = with_display(near, study.tables.code_value, {"event_cd": prefix, "result_units_cd": "result_units"})
    return named.select(
        F.col("alias").alias("fin"), to_local("event_end_dt_tm", zone).alias(f"{prefix}_datetime"), prefix,
        F.col("result_val").alias(f"{prefix}_result"), "result_units",
    ).distinct()


def electrolytes_24h(study: Study, zone: str = SITE_ZONE) -> DataFrame:
    """Electrolytes from one day before the start to one day after the stop."""
    day = timedelta(days=1)
    return _measured(study, C.ELECTROLYTES, day, day, "lab", zone)


def peri_event_vitals(study: Study, zone: str = SITE_ZONE) -> DataFrame:
    """Vitals, blood counts and temperatures from 6 hours before the start to 12 hours after the stop."""
    codes = [*C.VITALS, *C.TEMPERATURES]
    return _measured(study, codes, timedelta(hours=6), timedelta(hours=12), "vital", zone)


def event_meds(study: Study, zone: str = SITE_ZONE) -> DataFrame:
    """Resuscitation medication given between start and stop."""
    tables = study.tables
    given = _charted(tables, C.CLASS_MED, C.RESUSCITATION_MEDS, "event_id")
    none = timedelta(0)
    near = _around_index(study, given, none, none, width=timedelta(hours=1))
    near = near.join(tables.ce_med_result, "event_id")
    named = with_display(
        near, tables.code_value,
        {"event_cd": "medication", "dosage_unit_cd": "dose_units", "infusion_unit_cd": "rate_units",
         "iv_event_cd": "iv_event"},
    )
    return named.select(
        F.col("alias").alias("fin"), to_local("event_end_dt_tm", zone).alias("dose_datetime"), "medication",
        F.col("admin_dosage").alias("dose"), "dose_units", F.col("infusion_rate").alias("rate"), "rate_units",
        "iv_event",
    ).distinct()


def demographics(study: Study, zone: str = SITE_ZONE) -> DataFrame:
    """One row per account: length of stay, age, race, sex, first weight in kg, last resuscitation status."""
    cohort, tables = study.cohort, study.tables
    weights = before_bound(
        _charted(tables, C.CLASS_NUMERIC, [C.WEIGHT], "result_val",
                 extra=F.col("result_units_cd") == F.lit(C.KILOGRAM)),
        cohort.select(*_SUBJECT, "disch_dt_tm").distinct(), _SUBJECT, "event_end_dt_tm", "disch_dt_tm",
    )
    first_weight = keep_first(weights, ["encntr_id"], "event_end_dt_tm", {"weight": "result_val"})
    facts = attach(
        attach(cohort.join(tables.person, "person_id"), first_weight, "encntr_id"),
        _status_before(study), "encntr_id",
    )
    return with_display(facts, tables.code_value, {"race_cd": "race", "sex_cd": "sex"}).select(
        F.col("alias").alias("fin"), elapsed("disch_dt_tm", "reg_dt_tm", "days").alias("los"),
        whole_years(to_local("reg_dt_tm", zone), "birth_dt_tm").alias("age"), "race", "sex", "weight",
        "code_status", F.col("reason_for_visit").alias("admit_reason"),
    ).distinct()


def baseline_values(study: Study, zone: str = SITE_ZONE) -> DataFrame:
    """First values before discharge: per category and unit for temperature, arterial pressure and heart
    rate, per concept and unit for the severity labs. One scan serves all four sets."""
    cohort, tables = study.cohort, study.tables
    categories = {"temperature": C.TEMPERATURES, "pressure": C.ARTERIAL_PRESSURES, "heart": C.HEART_RATES}
    every = sorted({code for codes in (*categories.values(), C.SEVERITY) for code in codes})
    known = before_bound(
        _charted(tables, C.CLASS_NUMERIC, every, "result_val", "result_units_cd"),
        cohort.select(*_SUBJECT, "disch_dt_tm").distinct(), _SUBJECT, "event_end_dt_tm", "disch_dt_tm",
    )
    # No code is in two categories; a severity lab is a group of its own code. No code is in both lists.
    label = F.when(in_concepts("event_cd", C.SEVERITY), F.col("event_cd").cast("string"))
    for name, codes in categories.items():
        label = label.when(in_concepts("event_cd", codes), F.lit(name))
    firsts = keep_first(
        known.withColumn("__set", label), ["encntr_id", "__set", "result_units_cd"], "event_end_dt_tm",
        {"event_cd": "event_cd", "result_val": "result_val"}, time_as="event_end_dt_tm",
    ).select("encntr_id", "event_end_dt_tm", "event_cd", "result_val", "result_units_cd")
    named = with_display(
        firsts.join(cohort.select("encntr_id", "alias").distinct(), "encntr_id"), tables.code_value,
        {"event_cd": "event", "result_units_cd": "result_units"},
    )
    return named.select(
        F.col("alias").alias("fin"), to_local("event_end_dt_tm", zone).alias("event_datetime"), "event",
        F.col("result_val").alias("event_result"), "result_units",
    ).distinct()
