"""Registered queries: the extraction and analysis tables over study-shaped stand-ins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from anchorline.functions import concepts as C
from anchorline.operators import matching
from anchorline.plans import analysis, extraction, matched
from anchorline.registry import stand_ins as S
from anchorline.registry.operators import _FIT, BY_SCORE, _pairs_sql, recursive, register
from anchorline.registry.stand_ins import spark_table as table
from anchorline.registry.stand_ins import sql_with
from anchorline.session import stable

_LOCAL = "timezone('US/Central', timezone('UTC', {}))".format


def _codes(values) -> str:
    return ", ".join(str(v) for v in values)


# ---- extraction -------------------------------------------------------------------------------

def _study(spark, folder):
    return extraction.Study(S.account_list(spark, folder), S.warehouse(spark, folder))


@register(sql_with("intervals") + f"""
select distinct alias as fin, parent_event_id as code_event_id, {_LOCAL('start_ts')} as code_start_datetime,
       {_LOCAL('stop_ts')} as code_stop_datetime from intervals
""")
def code_dates(spark, folder):
    return extraction.code_dates(_study(spark, folder))


_STATUS = """
, first_start as (select encntr_id, min(start_ts) as t from code_start group by 1),
status_rows as (select f.encntr_id, d.oe_field_display_value as v,
    dense_rank() over (partition by f.encntr_id order by d.updt_dt_tm desc) as r
  from first_start f join resus_orders o on o.encntr_id = f.encntr_id join order_detail d on d.order_id = o.order_id
  where o.catalog_cd in (356259461, 2985032863, 2985032927) and o.current_start_dt_tm < f.t
    and d.oe_field_meaning_id = 229 and d.updt_dt_tm < f.t),
status as (select encntr_id, max(v) as code_status from status_rows where r = 1 group by 1)
"""


@register(sql_with("code_start", "resus_orders", "order_detail") + _STATUS + "select * from status")
def code_status(spark, folder):
    return extraction.code_status(_study(spark, folder))


@register(sql_with("intervals", "code_value") + f"""
select distinct i.alias as fin, i.parent_event_id as code_event_id, ce.event_id, cv.display as event, ce.result_val,
       {_LOCAL('dr.result_dt_tm')} as result_datetime
from intervals i join clinical_event ce on ce.parent_event_id = i.parent_event_id
join code_value cv on cv.code_value = ce.event_cd
left join ce_date_result dr on dr.event_id = ce.event_id and dr.valid_until_dt_tm > timestamp '2099-12-31'
where starts_with(cv.display, 'CPR Medication') or ce.event_class_cd = 99985
""")
def cpr_events(spark, folder):
    return extraction.cpr_events(_study(spark, folder))


def _measured_sql(codes, before: str, after: str, prefix: str) -> str:
    return sql_with("intervals", "code_value") + f"""
select distinct i.alias as fin, {_LOCAL('ce.event_end_dt_tm')} as {prefix}_datetime, cv.display as {prefix},
       ce.result_val as {prefix}_result, u.display as result_units
from intervals i join clinical_event ce on ce.encntr_id = i.encntr_id and ce.person_id = i.person_id
left join code_value cv on cv.code_value = ce.event_cd left join code_value u on u.code_value = ce.result_units_cd
where ce.event_class_cd = 159 and ce.event_cd in ({_codes(codes)})
  and ce.event_end_dt_tm between i.start_ts - interval {before} and i.stop_ts + interval {after}
  and ce.valid_until_dt_tm > timestamp '2099-12-31'
"""


@register(_measured_sql(C.ELECTROLYTES, "1 day", "1 day", "lab"))
def electrolytes_24h(spark, folder):
    return extraction.electrolytes_24h(_study(spark, folder))


@register(_measured_sql([*C.VITALS, *C.TEMPERATURES], "6 hour", "12 hour", "vital"))
def peri_event_vitals(spark, folder):
    return extraction.peri_event_vitals(_study(spark, folder))


@register(sql_with("intervals", "code_value", "ce_med_result") + f"""
select distinct i.alias as fin, {_LOCAL('ce.event_end_dt_tm')} as dose_datetime, cv.display as medication,
       m.admin_dosage as dose, du.display as dose_units, m.infusion_rate as rate, ru.display as rate_units,
       iv.display as iv_event
from intervals i join clinical_event ce on ce.encntr_id = i.encntr_id and ce.person_id = i.person_id
join ce_med_result m on m.event_id = ce.event_id left join code_value cv on cv.code_value = ce.event_cd
left join code_value du on du.code_value = m.dosage_unit_cd
left join code_value ru on ru.code_value = m.infusion_unit_cd
left join code_value iv on iv.code_value = m.iv_event_cd
where ce.event_class_cd = 158 and ce.event_cd in ({_codes(C.RESUSCITATION_MEDS)})
  and ce.event_end_dt_tm between i.start_ts and i.stop_ts and ce.valid_until_dt_tm > timestamp '2099-12-31'
""")
def event_meds(spark, folder):
    return extraction.event_meds(_study(spark, folder))


@register(sql_with("code_start", "resus_orders", "order_detail", "person", "code_value") + _STATUS + f"""
, weight_rows as (select p.encntr_id, ce.result_val as v,
    dense_rank() over (partition by p.encntr_id order by ce.event_end_dt_tm) as r
  from patients p join clinical_event ce on ce.encntr_id = p.encntr_id and ce.person_id = p.person_id
  where ce.event_class_cd = 159 and ce.event_cd = 30107 and ce.event_end_dt_tm < p.disch_dt_tm
    and ce.valid_until_dt_tm > timestamp '2099-12-31' and ce.result_units_cd = 170),
weight as (select encntr_id, max(v) as weight from weight_rows where r = 1 group by 1)
select distinct p.alias as fin, (epoch_us(e.disch_dt_tm) - epoch_us(e.reg_dt_tm))::double / 86400e6 as los,
  cast(trunc((epoch_us({_LOCAL('e.reg_dt_tm')}) - epoch_us(n.birth_dt_tm))::double / 86400e6 / 365.25::double)
       as int) as age,
  rc.display as race, sx.display as sex, w.weight, s.code_status, e.reason_for_visit as admit_reason
from patients p join encounter e on e.encntr_id = p.encntr_id join person n on n.person_id = p.person_id
left join status s on s.encntr_id = p.encntr_id left join weight w on w.encntr_id = p.encntr_id
left join code_value rc on rc.code_value = n.race_cd left join code_value sx on sx.code_value = n.sex_cd
""")
def demographics(spark, folder):
    return extraction.demographics(_study(spark, folder))


def _first_set(name: str, codes, by_code: bool) -> str:
    keys = "encntr_id, event_cd, result_units_cd" if by_code else "encntr_id, result_units_cd"
    shown = "event_cd" if by_code else "max(event_cd) as event_cd"
    return f""", {name}_rows as (select *, dense_rank() over (partition by {keys} order by event_end_dt_tm) as r
  from known where event_cd in ({_codes(codes)})),
{name} as (select encntr_id, min(event_end_dt_tm) as event_end_dt_tm, {shown}, max(result_val) as result_val,
  result_units_cd from {name}_rows where r = 1 group by {keys})"""


@register(sql_with("patients", "clinical_event", "code_value") + """
, known as (select p.encntr_id, ce.event_cd, ce.event_end_dt_tm, ce.result_val, ce.result_units_cd
  from patients p join clinical_event ce on ce.encntr_id = p.encntr_id and ce.person_id = p.person_id
  where ce.event_class_cd = 159 and ce.event_end_dt_tm < p.disch_dt_tm
    and ce.valid_until_dt_tm > timestamp '2099-12-31')
""" + _first_set("temps", C.TEMPERATURES, False) + _first_set("maps", C.ARTERIAL_PRESSURES, False)
          + _first_set("hr", C.HEART_RATES, False) + _first_set("labs", C.SEVERITY, True) + f"""
, baseline as (select * from temps union select * from maps union select * from hr union select * from labs)
select distinct p.alias as fin, {_LOCAL('b.event_end_dt_tm')} as event_datetime, cv.display as event,
       b.result_val as event_result, u.display as result_units
from baseline b join patients p on p.encntr_id = b.encntr_id left join code_value cv on cv.code_value = b.event_cd
left join code_value u on u.code_value = b.result_units_cd
""")
def baseline_values(spark, folder):
    return extraction.baseline_values(_study(spark, folder))


# ---- analysis ---------------------------------------------------------------------------------

def _anchors(spark, folder, one_per_subject=True):
    return analysis.anchors_from_list(table(spark, folder, "listed"), table(spark, folder, "ids"), one_per_subject)


def _include(spark, folder):
    return stable(analysis.study_set(_anchors(spark, folder), S.demographics(spark, folder)))


def _named(spark, folder, names):
    return table(spark, folder, "measures").where(F.col("event").isin(names))


def _temps(spark, folder):
    return table(spark, folder, "measures").where(F.col("event").contains("temperature"))


_TEMPS = [n for n in S.VIEW_NAMES if "temperature" in n]


def _sql_names(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _groups_sql(anchors: str) -> str:
    parts = [("temp", "contains(n.event, 'temperature')")]
    for name, events, low, high, mark in C.EVENT_GROUPS:
        test = f"n.event in ({_sql_names(events)})"
        if low is not None:
            test += f" and n.result {'>' if mark == 'exclusive' else '>='} {low}"
        if high is not None:
            test += f" and n.result < {high}"
        parts.append((name, test))
    near = f"""
, near as (select a.fin, m.event_ts, m.event_ts < a.code_ts as pre_code, m.event,
    try_cast(m.result as double) as result, contains(m.result, '<') as censor_low, contains(m.result, '>') as censor_high
  from measures m join {anchors} a on a.encntr_id = m.encntr_id
  where m.event_ts between a.code_ts - interval 24 hour and a.code_ts + interval 24 hour)
"""
    return near + "\nunion all ".join(
        f"select fin, event_ts, pre_code, '{name}' as event_group, event, result, censor_low, censor_high "
        f"from near n where {test}"
        for name, test in parts
    )


@register(sql_with("anchors", "measures") + _groups_sql("anchors"))
def event_groups(spark, folder):
    return analysis.event_groups(table(spark, folder, "measures"), _anchors(spark, folder))


@register(sql_with("anchored", "measures") + _groups_sql("anchored"))
def event_groups_all_anchors(spark, folder):
    return analysis.event_groups(table(spark, folder, "measures"), _anchors(spark, folder, one_per_subject=False))


@register(sql_with("visit_demo", "visits", "visit_ids", "weights") + """
, kept as (select * from visit_demo where facility <> 'SE Southeast'),
marked as (select v.*, k.admit_ts as index_ts, case when k.encntr_id is not null then v.encntr_id end as index_id
  from visits v left join kept k on k.encntr_id = v.encntr_id where v.visit_type = 'Inpatient'),
filled as (select admit_ts, disposition, facility, last_value(index_ts ignore nulls) over w as index_ts,
  last_value(index_id ignore nulls) over w as index_id from marked
  window w as (partition by person_id order by admit_ts, encntr_id rows between unbounded preceding and current row)),
back as (select index_id, facility as readmit_facility,
    (epoch_us(admit_ts) - epoch_us(index_ts))::double / 86400e6 as readmit_days from filled
  where disposition <> 'Cadaver Organ Donor' and admit_ts > index_ts and admit_ts <= index_ts + interval 30 day),
first_weight as (select encntr_id, cast(result as double) as weight from weights where event = 'weight'
  qualify row_number() over (partition by encntr_id order by event_ts, cast(result as double)) = 1)
select i.fin, k.age, k.gender, k.race, w.weight, k.length_stay, k.disposition, k.admit_ts, k.discharge_ts,
       b.readmit_facility, b.readmit_days
from kept k left join back b on b.index_id = k.encntr_id left join first_weight w on w.encntr_id = k.encntr_id
left join visit_ids i on i.encntr_id = k.encntr_id
""")
def patient_table(spark, folder):
    ids = table(spark, folder, "visit_ids")
    return analysis.patient_table(
        S.visit_demographics(spark, folder), table(spark, folder, "visits"), table(spark, folder, "weights"), ids, ids
    )


def _first_sql(names, single: str | None = None) -> str:
    return f"""(select encntr_id, event, result from numbers where event in ({_sql_names(names)})
  and encntr_id in (select encntr_id from include)
  qualify row_number() over (partition by encntr_id{'' if single else ', event'}
                             order by event_ts, {'event, ' if single else ''}result nulls last) = 1)"""


def _wide(names, source: str, value: str = "result") -> str:
    return ", ".join(f'max({source}.{value}) filter ({source}.event = \'{n}\') as "{n}"' for n in names)


@register(sql_with("include", "numbers") + f"""
, t as {_first_sql(_TEMPS, 'one')}, l as {_first_sql(S.LAB_NAMES)}, v as {_first_sql(S.CLICK_NAMES)},
g as {_first_sql(['glasgow coma score'], 'one')},
lw as (select encntr_id, {_wide(S.LAB_NAMES, 'l')} from l group by 1),
vw as (select encntr_id, {_wide(S.CLICK_NAMES, 'v')} from v group by 1)
select i.fin, t.result as temperature, g.result as gcs, lw.* exclude (encntr_id), vw.* exclude (encntr_id)
from include i left join t on t.encntr_id = i.encntr_id left join lw on lw.encntr_id = i.encntr_id
left join vw on vw.encntr_id = i.encntr_id left join g on g.encntr_id = i.encntr_id
""")
def admit_values(spark, folder):
    return analysis.admit_values(
        _include(spark, folder), _temps(spark, folder), _named(spark, folder, S.LAB_NAMES),
        _named(spark, folder, S.CLICK_NAMES), _named(spark, folder, ["glasgow coma score"]),
        S.LAB_NAMES, S.CLICK_NAMES,
    )


def _present(names, test: str, prefix: str = "") -> str:
    return ", ".join(f'coalesce(bool_or(m.med = \'{n}\' and {test}), false) as "{prefix}{n}"' for n in names)


@register(sql_with("include", "meds") + f"""
select i.fin, {_present(C.ANTIARRHYTHMICS, 'm.med_ts < i.code_ts', 'pre.')},
       {_present([*C.EVENT_MEDS, *S.ELECTROLYTE_NAMES], 'm.med_ts >= i.code_ts')}
from include i left join meds m on m.encntr_id = i.encntr_id group by i.encntr_id, i.fin
""")
def med_exposure(spark, folder):
    return analysis.med_exposure(_include(spark, folder), table(spark, folder, "meds"), S.ELECTROLYTE_NAMES)


def _peri_sql(names) -> str:
    return sql_with("include", "numbers") + f"""
, near as (select i.fin, n.event_ts, n.event, n.result, n.event_ts < i.code_ts as pre_code
  from numbers n join include i on i.encntr_id = n.encntr_id where n.event in ({_sql_names(names)})
  and n.event_ts >= i.code_ts - interval 6 hour and n.event_ts <= i.code_ts + interval 12 hour)
"""


def _series_sql(names) -> str:
    return _peri_sql(names) + f"""
, once as (select fin, event_ts, event, pre_code, min(result) as result from near group by all)
select fin, event_ts, pre_code, {_wide(names, 'once')} from once group by fin, event_ts, pre_code
"""


@register(_series_sql(S.CLICK_NAMES))
def wide_vitals(spark, folder):
    vitals = _named(spark, folder, S.CLICK_NAMES)
    return analysis.wide_series(_include(spark, folder), vitals, S.CLICK_NAMES)


@register(_series_sql(S.LAB_NAMES))
def wide_labs(spark, folder):
    return analysis.wide_series(_include(spark, folder), _named(spark, folder, S.LAB_NAMES), S.LAB_NAMES)


@register(_peri_sql(_TEMPS) + "select * from near")
def peri_code_temps(spark, folder):
    return analysis.peri_code(_include(spark, folder), _temps(spark, folder))


def _minmax_sql(names, by_concept: bool) -> str:
    key, on = (", n.event", ", event") if by_concept else ("", "")
    return sql_with("include", "numbers") + f"""
, early as (select n.encntr_id{key}, min(n.result) as min, max(n.result) as max
  from numbers n join include i on i.encntr_id = n.encntr_id join demo d on d.encntr_id = n.encntr_id
  where n.event in ({_sql_names(names)}) and n.event_ts <= d.admit_ts + interval 24 hour group by n.encntr_id{key})
select i.fin{on}, min, max from include i left join early e on e.encntr_id = i.encntr_id
"""


@register(_minmax_sql(S.CLICK_NAMES, True))
def admit_minmax_vitals(spark, folder):
    vitals = _named(spark, folder, S.CLICK_NAMES)
    return analysis.admit_minmax(_include(spark, folder), S.demographics(spark, folder), vitals)


@register(_minmax_sql(S.LAB_NAMES, True))
def admit_minmax_labs(spark, folder):
    labs = _named(spark, folder, S.LAB_NAMES)
    return analysis.admit_minmax(_include(spark, folder), S.demographics(spark, folder), labs)


@register(_minmax_sql(_TEMPS, False))
def admit_minmax_temps(spark, folder):
    return analysis.admit_minmax(
        _include(spark, folder), S.demographics(spark, folder), _temps(spark, folder), by_concept=False
    )


@register(_minmax_sql(["glasgow coma score"], False))
def admit_minmax_gcs(spark, folder):
    gcs = _named(spark, folder, ["glasgow coma score"])
    return analysis.admit_minmax(_include(spark, folder), S.demographics(spark, folder), gcs, by_concept=False)


@register(sql_with("include", "stays") + """
select s.encntr_id, i.fin, s.unit, s.arrive_ts, s.depart_ts, i.code_ts,
       i.code_ts between s.arrive_ts and s.depart_ts as code,
       (epoch_us(s.arrive_ts) - epoch_us(i.code_ts))::double / 3600e6 as time_code
from stays s join include i on i.encntr_id = s.encntr_id where s.depart_ts <= timestamp '2024-01-28 00:00:00'
and (i.code_ts between s.arrive_ts and s.depart_ts
     or (s.arrive_ts > i.code_ts and s.arrive_ts <= i.code_ts + interval 2 hour))
""")
def location_at_event(spark, folder):
    return analysis.location_at_event(
        _include(spark, folder), table(spark, folder, "stays"), dt.datetime(2024, 1, 28)
    ).select("encntr_id", "fin", "unit", "arrive_ts", "depart_ts", "code_ts", "code", "time_code")


_LAB_EVENTS = sql_with("x_index", "ids", "measures") + """
, spans as (select i.fin, x.start_ts as code_start, x.start_ts + interval 18 hour as code_end
  from x_index x join ids i on i.encntr_id = x.user_id where x.start_ts is not null),
labs as (select i.fin, m.encntr_id, m.event_ts, m.event, try_cast(m.result as double) as result
  from measures m join ids i on i.encntr_id = m.encntr_id
  where m.event in (""" + _sql_names(S.LAB_NAMES) + "))"


def _lab_events(spark, folder):
    from anchorline.registry.operators import x_index

    ids = table(spark, folder, "ids").select("encntr_id", "fin")
    spans = x_index(spark, folder).where("start_ts is not null").select(F.col("user_id").alias("encntr_id"), "start_ts")
    events = spans.join(ids, "encntr_id").selectExpr(
        "fin", "start_ts as code_start", "start_ts + interval 18 hour as code_end"
    )
    return analysis.numeric_result(_named(spark, folder, S.LAB_NAMES)).join(ids, "encntr_id"), events


@register(_LAB_EVENTS + f"""
, before as (select l.fin, l.encntr_id, l.event_ts, l.event, l.result from labs l
  where exists (select 1 from spans s where s.fin = l.fin and l.event_ts < s.code_start)),
last as (select * from before qualify row_number() over (partition by encntr_id, event
                                                         order by event_ts desc, result nulls last) = 1)
select fin, event_ts, {_wide(S.LAB_NAMES, 'last')} from last group by fin, event_ts
""")
def labs_prior(spark, folder):
    labs, events = _lab_events(spark, folder)
    return analysis.labs_before(labs, events, S.LAB_NAMES)


@register(_LAB_EVENTS + f"""
, inside as (select l.fin, l.event_ts, l.event, l.result from labs l join spans s on s.fin = l.fin
  and l.event_ts >= s.code_start and l.event_ts <= s.code_end)
select fin, event_ts, {_wide(S.LAB_NAMES, 'inside')} from inside group by fin, event_ts
""")
def labs_during(spark, folder):
    labs, events = _lab_events(spark, folder)
    return analysis.labs_during(labs, events, S.LAB_NAMES, strict=False)


# ---- matched cohort ---------------------------------------------------------------------------

_SHEET = {
    "id": "o_custkey", "fin": "'F' || cast(o_orderkey as {TEXT})", "cci": "cast(o_orderkey % 12 as double)",
    "code_start_date": "o_orderdate",
    "code_start_time": "o_orderdate + (o_orderkey % 1440) * interval 1 minute",
    "ca_given": "case when o_orderpriority = '1-URGENT' then 1 else 0 end",
    "code_end_date": "case when o_orderstatus = 'P' then o_orderdate + interval 1 day else o_orderdate end",
    "code_end_time": "o_orderdate + ((o_orderkey * 7 + o_custkey) % 1440) * interval 1 minute",
}
S.SPECS["sheet"] = ("orders", None, _SHEET)


def _features(spark, folder):
    rules = table(spark, folder, "customer").where("c_nationkey = 7").selectExpr(
        "c_custkey as id", "cast(null as timestamp_ntz) as only_start",
        "cast(timestamp '2001-01-01 00:00:00' as timestamp_ntz) as end_date",
    )
    return matched.matching_features(table(spark, folder, "sheet"), rules)


_FIXED = """
, fixed as (select s.*, case when c.c_custkey is not null then timestamp '2001-01-01 00:00:00' else code_end_date end
  as end_date from sheet s left join customer c on c.c_custkey = s.id and c.c_nationkey = 7),
features as (select fin, ca_given = 1 as ca_given, cci,
       (epoch_us(end_date + (code_end_time - date_trunc('day', code_end_time)))
        - epoch_us(code_start_date + (code_start_time - date_trunc('day', code_start_time))))::double / 60e6
       as code_duration from fixed)
"""
# The fit and the match know the columns by the names of the smaller study
_MATCHED = recursive(sql_with("sheet")) + _FIXED + """
, x_cov as (select fin as c_custkey, ca_given as treated, cci as c_acctbal, code_duration as n_orders from features)
""" + _FIT + _pairs_sql("scored", "''::varchar")


@register(sql_with("sheet") + _FIXED + "select fin, ca_given, cci, code_duration from features")
def matching_features(spark, folder):
    return _features(spark, folder)


@register(_MATCHED + """
select c_custkey as fin, treated as ca_given, x1 as cci, x2 as code_duration, round(score, 6) as distance,
       1.0::double as weights
from scored where c_custkey in (select treated_id from pairs union all select control_id from pairs)
""")
def matched_cohort(spark, folder):
    return matched.matched_cohort(_features(spark, folder))["matched"].withColumn("distance", F.round("distance", 6))


@register(_MATCHED + """
select t.c_custkey as treated_id, p.control_id from x_cov t left join pairs p on p.treated_id = t.c_custkey
where t.treated
""")
def match_pairs(spark, folder):
    return matched.matched_cohort(_features(spark, folder))["pairs"]


@register(_MATCHED + """
, used as (select treated_id as id from pairs union all select control_id from pairs),
tall as (select c_custkey, treated, 'cci' as variable, x1 as x from scored
  union all select c_custkey, treated, 'code_duration', x2 from scored
  union all select c_custkey, treated, 'distance', score from scored),
spread as (select variable, stddev_samp(x) as sd from tall where treated group by 1),
sets as (select 'all' as sample, * from tall
  union all select 'matched', * from tall where c_custkey in (select id from used)),
means as (select sample, variable, avg(x) filter (treated) as t, avg(x) filter (not treated) as c,
  stddev_samp(x) filter (not treated) as sd_c from sets group by 1, 2)
select sample, variable, round(t, 6) as mean_treated, round(c, 6) as mean_control, round(sd_c, 6) as sd_control,
       round(t - c, 6) + 0::double as mean_diff, round((t - c) / sd, 6) + 0::double as std_mean_diff
from means join spread using (variable)
""")
def match_balance(spark, folder):
    numbers = ["mean_treated", "mean_control", "sd_control", "mean_diff", "std_mean_diff"]
    balance = matched.matched_cohort(_features(spark, folder))["balance"]
    rounded = (F.round(c, 6) + F.lit(0.0) for c in numbers)  # no negative zero
    return balance.select("sample", "variable", *(x.alias(c) for c, x in zip(numbers, rounded, strict=True)))


@register(sql_with("x_cov") + """
, flagged as (select treated, not coalesce(c_acctbal between
    case when treated then (select min(c_acctbal) from x_cov where not treated)
         else (select min(c_acctbal) from x_cov where treated) end and
    case when treated then (select max(c_acctbal) from x_cov where not treated)
         else (select max(c_acctbal) from x_cov where treated) end, false) as discarded from x_cov),
sides as (select count(*) filter (treated) as nt, count(*) filter (not treated) as nc,
  count(*) filter (treated and discarded) as dt, count(*) filter (not treated and discarded) as dc from flagged),
pairs as (select *, least(nt - dt, nc - dc) as n from sides)
select 'all' as units, nt as treated, nc as control from pairs
union all select 'matched', n, n from pairs
union all select 'unmatched', nt - dt - n, nc - dc - n from pairs
union all select 'discarded', dt, dc from pairs
""")
def match_counts(spark, folder):
    units = matching.in_support(S.x_cov(spark, folder), "treated", "c_acctbal")
    pairs = matching.greedy_match(units.where("in_support"), "c_custkey", "treated", "c_acctbal")
    ids = matching.matched_ids(pairs, "c_custkey").withColumn("matched", F.lit(True))
    flagged = units.join(ids, "c_custkey", "left").withColumns(
        {"matched": F.coalesce("matched", F.lit(False)), "discarded": ~F.col("in_support")}
    )
    return matching.sample_counts(flagged, "treated", "matched", "discarded")


# The same study over the customers, small enough for a row-by-row SQL match

_COVARIATES = ["c_acctbal", "n_orders"]


def _customer_match(spark, folder):
    return matched.matched_cohort(S.x_cov(spark, folder), "c_custkey", "treated", _COVARIATES)


@register(BY_SCORE + """
select t.c_custkey as treated_id, p.control_id from x_cov t left join pairs p on p.treated_id = t.c_custkey
where t.treated
""")
def customer_match_pairs(spark, folder):
    return _customer_match(spark, folder)["pairs"]


@register(BY_SCORE + """
select c_custkey, treated, x1 as c_acctbal, cast(x2 as bigint) as n_orders, round(score, 6) as distance,
       1.0::double as weights
from scored where c_custkey in (select treated_id from pairs union all select control_id from pairs)
""")
def customer_match_sample(spark, folder):
    return _customer_match(spark, folder)["matched"].withColumn("distance", F.round("distance", 6))


@register(BY_SCORE + """
, used as (select treated_id as id from pairs union all select control_id from pairs),
tall as (select c_custkey, treated, 'c_acctbal' as variable, x1 as x from scored
  union all select c_custkey, treated, 'n_orders', x2 from scored
  union all select c_custkey, treated, 'distance', score from scored),
spread as (select variable, stddev_samp(x) as sd from tall where treated group by 1),
sets as (select 'all' as sample, * from tall
  union all select 'matched', * from tall where c_custkey in (select id from used)),
means as (select sample, variable, avg(x) filter (treated) as t, avg(x) filter (not treated) as c,
  stddev_samp(x) filter (not treated) as sd_c from sets group by 1, 2)
select sample, variable, round(t, 5) as mean_treated, round(c, 5) as mean_control, round(sd_c, 5) as sd_control,
       round(t - c, 5) as mean_diff, round((t - c) / sd, 5) as std_mean_diff
from means join spread using (variable)
""")
def customer_match_balance(spark, folder):
    numbers = ["mean_treated", "mean_control", "sd_control", "mean_diff", "std_mean_diff"]
    balance = _customer_match(spark, folder)["balance"]
    return balance.select("sample", "variable", *(F.round(c, 5).alias(c) for c in numbers))


@register(BY_SCORE + """
, used as (select treated_id as id from pairs union all select control_id from pairs),
tall as (select c_custkey, treated, 'c_acctbal' as variable, x1 as x from scored
  union all select c_custkey, treated, 'n_orders', x2 from scored),
sets as (select 'all' as sample, treated, variable, x from tall
  union all select 'matched', treated, variable, x from tall where c_custkey in (select id from used)),
spots as (select distinct sample, variable, x as spot from sets),
shares as (select sample, variable, spot,
    abs(avg((x <= spot)::int) filter (treated) - avg((x <= spot)::int) filter (not treated)) as gap
  from spots join sets using (sample, variable) group by sample, variable, spot),
lists as (select sample, variable, list(x order by x) filter (treated) as t, list(x order by x) filter (not treated) as c
  from sets group by sample, variable),
sized as (select sample, variable, case when len(t) <= len(c) then t else c end as small,
    case when len(t) <= len(c) then c else t end as large from lists),
ranks as (select *, unnest(range(len(small))) as k from sized),
places as (select *, case when len(small) = 1 then 0 else k * (len(large) - 1) // (len(small) - 1) end as f,
    case when len(small) = 1 then 0.0 else (k * (len(large) - 1) % (len(small) - 1))::double / (len(small) - 1) end as past
  from ranks),
diffs as (select sample, variable,
    abs(small[k + 1] - (large[f + 1] + past * (coalesce(large[f + 2], large[f + 1]) - large[f + 1]))) as diff from places),
quantiles as (select sample, variable, avg(diff) as mean, median(diff) as median, max(diff) as most from diffs
  group by sample, variable)
select sample, variable, round(avg(gap), 6) as ecdf_mean, round(max(gap), 6) as ecdf_max, round(any_value(mean), 6) as eqq_mean,
  round(any_value(median), 6) as eqq_median, round(any_value(most), 6) as eqq_max
from shares join quantiles using (sample, variable) group by sample, variable
""")
def balance_distances(spark, folder):
    """Distances of the distributions of both groups, before and after matching."""
    distances = matched.matched_distances(_customer_match(spark, folder), "treated", _COVARIATES)
    numbers = ["ecdf_mean", "ecdf_max", "eqq_mean", "eqq_median", "eqq_max"]
    return distances.select("sample", "variable", *(F.round(c, 6).alias(c) for c in numbers))
