"""Analysis tables from extracts.

Inputs use these column names: `encntr_id` subject, `fin` account number, `person_id`, `code_ts` anchor,
`event_ts`/`event`/`result` for a measurement, `med_ts`/`med` for a dose. `include` is the study set, one
row per subject: (encntr_id, fin, code_ts, ...).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.functions import concepts as C
from anchorline.functions.clean import (
    censored_number, dense_booleans, exclude_value, front, in_concepts, is_before, matches, to_number, within_limits,
)
from anchorline.functions.times import compose
from anchorline.operators.cohort import attach, first_anchor, restrict
from anchorline.operators.extremes import minmax
from anchorline.operators.firsts import dedupe_first, first_row_per_concept, first_row_per_subject, nulls_last
from anchorline.operators.readmit import readmissions
from anchorline.operators.reshape import assemble, discover_values, pivot_values, presence_columns
from anchorline.operators.windows import (
    first_hours, from_bound, in_interval_window, in_point_window, last_before, stay_at_anchor,
)
from anchorline.session import stable

_DAY = timedelta(days=1)


def _smallest() -> Column:
    """Of results at one time, the smallest number."""
    return nulls_last("result")


def anchors_from_list(listed: DataFrame, ids: DataFrame, one_per_subject: bool = True) -> DataFrame:
    """Patient list (fin, date, time) with internal ids: (encntr_id, fin, code_ts, ...). Listed accounts
    without an id together count as one subject when reduced to one anchor per subject."""
    dated = listed.select("fin", compose("date", "time").alias("code_ts"))
    known = attach(dated, ids, "fin")
    return first_anchor(known, "encntr_id", "code_ts", ["fin"]) if one_per_subject else known


def study_set(anchors: DataFrame, demographics: DataFrame, facility: str = "facility") -> DataFrame:
    """Anchors of subjects who have demographics outside the excluded facility."""
    kept = exclude_value(demographics, facility, C.EXCLUDED_FACILITY)
    return restrict(anchors, kept.select("encntr_id"), "encntr_id")


def numeric_result(df: DataFrame, column: str = "result") -> DataFrame:
    """Text results as numbers; numbers stay."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, to_number(column))
    return df


def event_groups(measures: DataFrame, anchors: DataFrame, before: timedelta = _DAY, after: timedelta = _DAY) -> DataFrame:
    """The nine cleaned measurement sets around the anchor, stacked under `event_group`. Anchors may
    repeat a subject: each anchor then gets its own rows."""
    named = C.TEMPERATURE_WORD
    wanted = F.col("event").isin([n for _, names, *_ in C.EVENT_GROUPS for n in names]) | F.col("event").contains(named)
    near = in_point_window(
        measures.where(wanted).select("encntr_id", "event_ts", "event", "result"),
        anchors.select("encntr_id", "fin", "code_ts"), ["encntr_id"], "event_ts", "code_ts", before, after,
    )
    group = F.when(F.col("event").contains(named), F.lit(C.TEMPERATURE_GROUP))
    for name, events, low, high, mark in C.EVENT_GROUPS:
        plausible = in_concepts("event", events) & within_limits("result", low, high, mark == "exclusive")
        group = group.when(plausible, F.lit(name))
    return (
        censored_number(near, "result")
        .withColumns({"event_group": group, "pre_code": is_before("event_ts", "code_ts")})
        .where(F.col("event_group").isNotNull())
        .select("fin", "event_ts", "pre_code", "event_group", "event", "result", "censor_low", "censor_high")
    )


def first_result(df: DataFrame, event: str | None, name: str) -> DataFrame:
    """First result per subject: (encntr_id, `name`)."""
    kept = df.where(F.col("event") == F.lit(event)) if event else df
    rows = first_row_per_subject(numeric_result(kept), "encntr_id", "event_ts", ["event", _smallest()])
    return rows.select("encntr_id", F.col("result").alias(name))


def patient_table(demographics: DataFrame, visits: DataFrame, weights: DataFrame, ids: DataFrame,
                  include: DataFrame) -> DataFrame:
    """Demographics with first weight and readmissions within 30 days (one row per readmission).

    `visits`: encntr_id, person_id, admit_ts, visit_type, disposition, facility."""
    kept = exclude_value(demographics, "facility", C.EXCLUDED_FACILITY)
    index = kept.select("encntr_id", F.col("admit_ts").alias("index_ts"))
    inpatient = attach(visits.where(F.col("visit_type") == F.lit(C.INPATIENT)), index, "encntr_id")
    back = readmissions(
        inpatient, "person_id", "encntr_id", "admit_ts", "index_ts", "disposition", C.EXCLUDED_DISPOSITION,
    ).select(F.col("index_id").alias("encntr_id"), F.col("facility").alias("readmit_facility"), "readmit_days")
    weight = first_result(restrict(weights, include.select("encntr_id"), "encntr_id"), "weight", "weight")
    return assemble(kept, [back, weight, ids.select("encntr_id", "fin").distinct()], "encntr_id").select(
        "fin", "age", "gender", "race", "weight", "length_stay", "disposition", "admit_ts", "discharge_ts",
        "readmit_facility", "readmit_days",
    )


def first_values_wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """First result per (subject, concept), one column per concept."""
    kept = numeric_result(df.where(in_concepts("event", names)))
    firsts = first_row_per_concept(kept, "encntr_id", "event", "event_ts", [_smallest()])
    return pivot_values(firsts, ["encntr_id"], "event", "result", names, strict=True)


def admit_values(include: DataFrame, temps: DataFrame, labs: DataFrame, vitals: DataFrame, gcs: DataFrame,
                 lab_names: Sequence[str] | None = None, vital_names: Sequence[str] | None = None) -> DataFrame:
    """First temperature, labs, vitals and coma score of each subject in the study set, one row each.
    Without given names, the names found in the data become the columns. Each part is restricted to the study
    set before anything is sorted or aggregated."""
    temps, labs, vitals, gcs = (
        restrict(df, include.select("encntr_id"), "encntr_id") for df in (temps, labs, vitals, gcs)
    )
    lab_names = lab_names or discover_values(labs, "event")
    vital_names = vital_names or discover_values(vitals, "event")
    frames = [
        first_result(temps, None, "temperature"),
        first_values_wide(labs, lab_names),
        first_values_wide(vitals, vital_names),
        first_result(gcs, "glasgow coma score", "gcs"),
    ]
    return front(assemble(include.select("encntr_id", "fin"), frames, "encntr_id"), ["fin"], drop=["encntr_id"])


def med_exposure(include: DataFrame, meds: DataFrame, electrolyte_names: Sequence[str] | None = None) -> DataFrame:
    """Booleans per subject: anti-arrhythmics before the anchor, event drugs and electrolytes from it on."""
    bounds = include.select("encntr_id", "code_ts")
    if electrolyte_names is None:
        electrolytes = meds.where(matches("med", C.ELECTROLYTE_MEDS_PATTERN))
        electrolyte_names = discover_values(
            from_bound(electrolytes, bounds, ["encntr_id"], "med_ts", "code_ts"), "med"
        )
    later = [*C.EVENT_MEDS, *electrolyte_names]
    doses = meds.where(in_concepts("med", {*C.ANTIARRHYTHMICS, *later})).join(bounds, "encntr_id")
    before = is_before("med_ts", "code_ts")
    given = doses.groupBy("encntr_id").agg(
        *presence_columns("med", C.ANTIARRHYTHMICS, prefix="pre.", when=before),
        *presence_columns("med", later, when=F.col("med_ts") >= F.col("code_ts")),
    )
    wide = assemble(include.select("encntr_id", "fin"), [given], "encntr_id")
    return dense_booleans(front(wide, ["fin", "pre.*"], drop=["encntr_id"]))


def peri_code(include: DataFrame, df: DataFrame, before: timedelta = timedelta(hours=6),
              after: timedelta = timedelta(hours=12)) -> DataFrame:
    """Measurements around the anchor, tall: (fin, event_ts, event, result, pre_code)."""
    near = in_point_window(
        df.select("encntr_id", "event_ts", "event", "result"), include.select("encntr_id", "fin", "code_ts"),
        ["encntr_id"], "event_ts", "code_ts", before, after,
    )
    flagged = numeric_result(near).withColumn("pre_code", is_before("event_ts", "code_ts"))
    return flagged.select("fin", "event_ts", "event", "result", "pre_code")


def wide_series(include: DataFrame, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """`peri_code` without repeats, one row per (fin, time) and one column per concept."""
    near = peri_code(include, df)
    names = names or discover_values(near, "event")
    once = dedupe_first(near, ["fin", "event_ts", "event"], [_smallest()])
    return pivot_values(once, ["fin", "event_ts", "pre_code"], "event", "result", names, strict=True)


def admit_minmax(include: DataFrame, demographics: DataFrame, df: DataFrame, by_concept: bool = True,
                 hours: int = 24) -> DataFrame:
    """Minimum and maximum up to `hours` after admission; study subjects without a value keep one row."""
    kept = exclude_value(demographics, "facility", C.EXCLUDED_FACILITY).select("encntr_id", "admit_ts")
    kept = restrict(kept, include.select("encntr_id"), "encntr_id")
    early = first_hours(numeric_result(df), kept, ["encntr_id"], "event_ts", "admit_ts", hours)
    keys = ["encntr_id", "event"] if by_concept else ["encntr_id"]
    wide = assemble(include.select("encntr_id", "fin"), [minmax(early, keys, "result")], "encntr_id")
    return front(wide, ["fin"], drop=["encntr_id"])


def location_at_event(include: DataFrame, stays: DataFrame, as_of: datetime) -> DataFrame:
    """Stays that ended by `as_of` and cover the anchor or begin within two hours after it."""
    ended = stays.where(F.col("depart_ts") <= F.lit(as_of).cast("timestamp_ntz"))
    return stay_at_anchor(
        ended, include.select("encntr_id", "fin", "code_ts"), ["encntr_id"], "arrive_ts", "depart_ts", "code_ts",
        flag="code", hours="time_code",
    )


def labs_before(labs: DataFrame, events: DataFrame, names: Sequence[str]) -> DataFrame:
    """Last value of each lab before an event of the account, wide by (fin, time). `events`: fin, code_start,
    code_end."""
    last = last_before(labs, events, ["fin"], "event_ts", "code_start", ["encntr_id", "event"], [_smallest()])
    return pivot_values(last, ["fin", "event_ts"], "event", "result", names, strict=True)


def labs_during(labs: DataFrame, events: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    """Labs taken during an event, wide by (fin, time). Two results of one lab at one time have no wide
    form: the query fails, or with `strict=False` keeps the larger."""
    inside = in_interval_window(
        labs, events.select("fin", "code_start", "code_end"), ["fin"], "event_ts", "code_start", "code_end"
    )
    return pivot_values(inside, ["fin", "event_ts"], "event", "result", names, strict)


def labs_before_during(labs: DataFrame, events: DataFrame, names: Sequence[str] | None = None) -> Mapping[str, DataFrame]:
    """Both lab tables of the blood-gas study."""
    names = names or discover_values(labs, "event")
    return {"labs_prior": labs_before(labs, events, names), "labs_during": labs_during(labs, events, names)}


def study_tables(include: DataFrame, demographics: DataFrame, visits: DataFrame, ids: DataFrame,
                 measures: Mapping[str, DataFrame], meds: DataFrame) -> dict[str, DataFrame]:
    """The named tables of one study year. `measures` holds vitals, temps, labs, weights and gcs. The study
    set, one row per subject, is written once, as every table starts from it."""
    include = stable(include)
    return {
        "patients": patient_table(demographics, visits, measures["weights"], ids, include),
        "admit_values": admit_values(include, measures["temps"], measures["labs"], measures["vitals"], measures["gcs"]),
        "meds": med_exposure(include, meds),
        "vitals": wide_series(include, measures["vitals"]),
        "temps": peri_code(include, measures["temps"]),
        "labs": wide_series(include, measures["labs"]),
    }


def minmax_tables(include: DataFrame, demographics: DataFrame, measures: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The named tables of admission extremes."""
    include = stable(include)
    gcs = measures["gcs"].where(F.col("event") == F.lit("glasgow coma score"))
    return {
        "vitals": admit_minmax(include, demographics, measures["vitals"]),
        "temps": admit_minmax(include, demographics, measures["temps"], by_concept=False),
        "labs": admit_minmax(include, demographics, measures["labs"]),
        "gcs": admit_minmax(include, demographics, gcs, by_concept=False),
    }
