"""Study-shaped tables derived from the given tables, for Spark and as SQL text.

Each stand-in is a projection of one given table. `{TS}` and `{TEXT}` are the type names of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions import concepts as C
from anchorline.session import small_table
from anchorline.sources.warehouse import Tables

OPEN = "timestamp '2100-12-31 00:00:00'"
CLOSED = "timestamp '2020-01-01 00:00:00'"
PERSON = 500000000
SHIFT = "interval 9000 day"

CLICK_NAMES = [
    "systolic blood pressure", "arterial systolic bp 1", "diastolic blood pressure", "arterial diastolic bp 1",
    "mean arterial pressure", "mean arterial pressure (invasive)", "apical heart rate", "peripheral pulse rate",
    "respiratory rate", "spo2 percent",
]
VIEW_NAMES = [
    "temperature oral", "temperature", "temperature bladder", "hgb", "hct", "wbc", "potassium lvl", "weight",
    "glasgow coma score", "sodium lvl",
]
MED_NAMES = [
    "amiodarone", "lidocaine", "dopamine", "epinephrine", "vasopressin", "potassium chloride", "sodium phosphate",
    "calcium chloride", "x potassium", "magnesium sulfate", "milrinone", "heparin",
]
LAB_NAMES = ["hgb", "hct", "wbc", "potassium lvl", "sodium lvl"]
ELECTROLYTE_NAMES = ["calcium chloride", "magnesium sulfate", "potassium chloride", "sodium phosphate"]
CLICK_CODES = [30724, 32170, 32387, 522187789, 119822453, 173814326, 30065, 119822527]
VIEW_CODES = [30100, 119822492, 119822536, 31806, 31854, 30094, 30107, 134422765]
MED_CODES = [37556392, 37556106, 37556849, 37556211, 900001, 900002]


def _choose(values, by: str) -> str:
    items = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    branches = " ".join(f"when {i} then {v}" for i, v in enumerate(items[:-1]))
    return f"case {by} % {len(items)} {branches} else {items[-1]} end"


_HOUR = "cast(date_trunc('hour', ts) as {TS})"
_WHOLE = "cast(cast(floor(value) as int) as {TEXT})"
_PARENT = "user_id * 1000000 + (year(ts) - 2000) * 1000 + dayofyear(ts)"

# Declared, so that no file is opened to plan a query
GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

# name: (given table, condition, {column: expression})
SPECS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "x_event": ("events", None, {
        "event_id": "event_id", "user_id": "user_id", "parent_id": f"cast({_PARENT} as bigint)", "ts": "ts",
        "event_type": "event_type", "value": "value",
    }),
    "x_measure": ("lineitem", None, {
        "encntr_id": "l_orderkey", "line_no": "l_linenumber", "event_cd": "l_partkey", "event_end": "l_shipdate",
        "result_val": "cast(cast(l_quantity as int) as {TEXT})", "unit": "l_returnflag",
        "valid_until": f"cast(case when l_linestatus = 'O' then {OPEN} else {CLOSED} end as {{TS}})",
        "line_status": "l_linestatus",
    }),
    "x_text": ("lineitem", None, {
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber",
        "result_val": "case when l_quantity < 5 then '<5' when l_quantity > 45 then '>45' "
                      "when l_quantity = 13 then 'n/a' when l_quantity = 14 then '7d' "
                      "else cast(cast(l_quantity as int) as {TEXT}) end",
    }),
    "x_visit": ("orders", None, {
        "person_id": "o_custkey", "encntr_id": "o_orderkey", "admit_ts": "o_orderdate",
        "index_ts": "case when o_orderstatus = 'F' then o_orderdate end", "disposition": "o_orderpriority",
    }),
    "x_stay": ("events", None, {
        "event_id": "event_id", "user_id": "user_id", "unit": "event_type", "arrive_ts": "ts",
        "depart_ts": "case when event_id % 7 = 0 then null else ts + (event_id % 48) * interval 1 hour end",
    }),
    # Warehouse
    "encntr_alias": ("customer", None, {
        "encntr_id": "c_custkey", "alias": "c_name",
        "encntr_alias_type_cd": "cast(case when c_mktsegment = 'MACHINERY' then 1 else 619 end as bigint)",
    }),
    "person": ("customer", None, {
        "person_id": f"c_custkey + {PERSON}",
        "birth_dt_tm": "cast(timestamp '1940-01-01 00:00:00' as {TS}) + ((c_custkey * 37) % 25000) * interval 1 day",
        "race_cd": "cast(c_nationkey as bigint)", "sex_cd": "cast(362 + c_custkey % 3 as bigint)",
    }),
    "clinical_event": ("events", None, {
        "event_id": "event_id", "parent_event_id": f"cast({_PARENT} as bigint)", "encntr_id": "user_id",
        "person_id": f"user_id + {PERSON}",
        "event_cd": f"cast(case event_type when 'signup' then {C.INDEX_START} when 'purchase' then {C.INDEX_STOP} "
                    f"when 'click' then {_choose(CLICK_CODES, 'event_id')} "
                    f"when 'view' then {_choose(VIEW_CODES, 'event_id')} "
                    f"else {_choose(MED_CODES, 'event_id')} end as bigint)",
        "event_class_cd": f"cast(case event_type when 'signup' then {C.CLASS_DATE} when 'purchase' then {C.CLASS_DATE} "
                          f"when 'error' then {C.CLASS_MED} else {C.CLASS_NUMERIC} end as bigint)",
        "event_end_dt_tm": _HOUR, "result_val": _WHOLE,
        "result_units_cd": "cast(case when event_id % 5 = 0 then null when event_id % 2 = 0 then 170 else 171 end "
                           "as bigint)",
        "valid_until_dt_tm": f"cast(case when event_id % 11 = 0 then {CLOSED} else {OPEN} end as {{TS}})",
    }),
    "ce_date_result": ("events", "event_type in ('signup', 'purchase')", {
        "event_id": "event_id", "result_dt_tm": "ts",
        "valid_until_dt_tm": f"cast(case when event_id % 13 = 0 then {CLOSED} else {OPEN} end as {{TS}})",
    }),
    "ce_med_result": ("events", "event_type = 'error'", {
        "event_id": "event_id", "admin_dosage": "value", "dosage_unit_cd": "cast(170 + event_id % 2 as bigint)",
        "infusion_rate": "case when event_id % 3 = 0 then value * 2 end",
        "infusion_unit_cd": "cast(case when event_id % 3 = 0 then 172 end as bigint)",
        "iv_event_cd": "cast(case when event_id % 3 = 0 then 736 end as bigint)",
    }),
    "resus_orders": ("orders", None, {
        "order_id": "o_orderkey", "encntr_id": "o_custkey",
        "catalog_cd": "cast(case o_orderpriority when '1-URGENT' then 356259461 when '2-HIGH' then 2985032863 "
                      "when '3-MEDIUM' then 2985032927 else 1 end as bigint)",
        "current_start_dt_tm": f"o_orderdate + {SHIFT}",
    }),
    "order_detail": ("lineitem", None, {
        "order_id": "l_orderkey",
        "oe_field_meaning_id": "cast(case when l_linestatus = 'O' then 229 else 1 end as bigint)",
        "oe_field_display_value": "l_returnflag || '-' || cast(l_linenumber as {TEXT})",
        "updt_dt_tm": f"l_shipdate + {SHIFT}",
    }),
    # Extracts
    "ids": ("customer", "c_mktsegment <> 'MACHINERY'", {
        "encntr_id": "c_custkey", "fin": "c_name", "person_id": f"c_custkey + {PERSON}",
    }),
    "listed": ("events", "event_type = 'signup'", {
        "fin": "'Customer#' || lpad(cast(user_id as {TEXT}), 9, '0')",
        "date": "cast(date_trunc('day', ts) as {TS})", "time": "ts",
    }),
    "measures": ("events", "event_type in ('click', 'view')", {
        "encntr_id": "user_id", "event_ts": _HOUR,
        "event": f"case event_type when 'click' then {_choose(CLICK_NAMES, 'event_id')} "
                 f"else {_choose(VIEW_NAMES, 'event_id')} end",
        "result": "case when event_id % 17 = 0 then '<5' when event_id % 19 = 0 then '>200' "
                  "when event_id % 23 = 0 then 'n/a' else cast(cast(floor(value * 10) as int) as {TEXT}) end",
    }),
    "meds": ("events", "event_type = 'error'", {
        "encntr_id": "user_id", "med_ts": "ts", "med": _choose(MED_NAMES, "event_id"),
    }),
    "stays": ("events", "event_type = 'purchase'", {
        "encntr_id": "user_id", "unit": "'unit ' || cast(event_id % 5 as {TEXT})", "arrive_ts": "ts",
        "depart_ts": "case when event_id % 7 = 0 then null else ts + (event_id % 48) * interval 1 hour end",
    }),
    "visits": ("orders", None, {
        "encntr_id": "o_orderkey", "person_id": "o_custkey", "admit_ts": "o_orderdate",
        "visit_type": "case when o_orderpriority = '5-LOW' then 'Outpatient' else 'Inpatient' end",
        "disposition": "case when o_orderstatus = 'P' then 'Cadaver Organ Donor' else 'Home' end",
        "facility": "o_orderpriority",
    }),
    "visit_ids": ("orders", None, {
        "encntr_id": "o_orderkey", "fin": "'F' || cast(o_orderkey as {TEXT})",
    }),
    "weights": ("lineitem", None, {
        "encntr_id": "l_orderkey", "event_ts": "l_shipdate",
        "event": "case when l_linestatus = 'O' then 'weight' else 'height' end",
        "result": "cast(cast(l_quantity as int) as {TEXT})",
    }),
}


def spark_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, or a stand-in derived from it."""
    source, condition, columns = SPECS.get(name, (name, None, {}))
    df = spark.read.schema(GIVEN[source]).parquet(f"{folder}/{source}.parquet")
    if not columns:
        return df
    if condition:
        df = df.where(condition)
    # every name in an expression is a column of the given table
    return df.selectExpr(
        *(f"{e.replace('{TS}', 'timestamp_ntz').replace('{TEXT}', 'string')} as {c}" for c, e in columns.items())
    )


def _sql_spec(name: str) -> str:
    source, condition, columns = SPECS[name]
    shown = ", ".join(
        f"{e.replace('{TS}', 'timestamp').replace('{TEXT}', 'varchar')} as {c}" for c, e in columns.items()
    )
    return f"select {shown} from {source}" + (f" where {condition}" if condition else "")


def _code_rows() -> list[tuple[int, str]]:
    """Display names outside the nations: concept names, units and other codes."""
    names = {code: text for codes in C.CONCEPT_SETS.values() for code, text in codes.items()}
    names |= {
        C.WEIGHT: "Weight", C.INDEX_START: "CPR D/T Event Recognized", C.INDEX_STOP: "CPR Event Ended at",
        C.KILOGRAM: "kg", 171: "lb", 172: "mL/hr", 362: "Female", 363: "Male", 736: "Begin Bag",
        900001: "CPR Medication given", 900002: "Other CPR Medication",
    }
    return sorted(names.items())


# Stand-ins that need more than one projection, as SQL
_SQL = {
    "x_index": "select user_id, parent_id, min(ts) filter (event_type = 'signup') as start_ts, "
               "max(ts) filter (event_type = 'purchase') as stop_ts from x_event "
               "where event_type in ('signup', 'purchase') group by user_id, parent_id",
    "x_anchor": "select user_id, min(ts) as anchor_ts from events where event_type = 'signup' group by user_id",
    "x_admit": "select user_id, min(ts) as admit_ts, max(ts) as disch_ts from events group by user_id",
    "x_cov": "select c_custkey, c_mktsegment = 'BUILDING' as treated, c_acctbal, count(o_orderkey) as n_orders "
             "from customer left join orders on o_custkey = c_custkey group by c_custkey, c_mktsegment, c_acctbal",
    "encounter": f"select c_custkey as encntr_id, c_custkey + {PERSON} as person_id, a.admit_ts as reg_dt_tm, "
                 "a.disch_ts as disch_dt_tm, c_mktsegment as reason_for_visit "
                 "from customer left join x_admit a on a.user_id = c_custkey",
    "code_value": "select cast(n_nationkey as bigint) as code_value, n_name as display from nation union all "
                  "select * from (values "
                  + ", ".join(f"({code}, '{text}')" for code, text in _code_rows()) + ") v(code_value, display)",
    "patients": "select distinct e.encntr_id, e.person_id, a.alias, e.disch_dt_tm, e.reg_dt_tm from encntr_alias a "
                "join encounter e on e.encntr_id = a.encntr_id where a.encntr_alias_type_cd = 619",
    "index_rows": "select distinct p.encntr_id, ce.event_id, ce.parent_event_id, ce.event_cd, dr.result_dt_tm "
                  "from patients p join clinical_event ce on ce.encntr_id = p.encntr_id "
                  "and ce.person_id = p.person_id join ce_date_result dr on dr.event_id = ce.event_id "
                  f"where ce.event_class_cd = 99985 and ce.event_cd in ({C.INDEX_START}, {C.INDEX_STOP}) "
                  "and dr.valid_until_dt_tm > timestamp '2099-12-31'",
    "code_start": "select encntr_id, parent_event_id, min(result_dt_tm) as start_ts from index_rows "
                  f"where event_cd = {C.INDEX_START} group by all",
    "code_end": "select parent_event_id, max(result_dt_tm) as stop_ts from index_rows "
                f"where event_cd = {C.INDEX_STOP} group by all",
    "intervals": "select distinct p.encntr_id, p.person_id, p.alias, i.parent_event_id, s.start_ts, e.stop_ts "
                 "from patients p left join index_rows i on i.encntr_id = p.encntr_id "
                 "left join code_start s on s.parent_event_id = i.parent_event_id "
                 "left join code_end e on e.parent_event_id = i.parent_event_id",
    "demo": "select c_custkey as encntr_id, a.admit_ts, a.disch_ts as discharge_ts, "
            "case when c_nationkey = 3 then 'SE Southeast' when c_nationkey = 4 then null else 'Main' end as facility "
            "from customer left join x_admit a on a.user_id = c_custkey",
    "anchored": "select i.encntr_id, l.fin, i.person_id, l.time as code_ts "
                "from listed l left join ids i on i.fin = l.fin",
    "anchors": "select * from anchored qualify row_number() over (partition by encntr_id order by code_ts, fin) = 1",
    "include": "select a.* from anchors a where exists (select 1 from demo d where d.encntr_id = a.encntr_id "
               "and d.facility <> 'SE Southeast')",
    "numbers": "select encntr_id, event_ts, event, try_cast(result as double) as result from measures",
    "visit_demo": "select o_orderkey as encntr_id, cast(o_custkey % 90 as int) as age, o_orderstatus as gender, "
                  "c_mktsegment as race, o_totalprice as length_stay, 'Home' as disposition, "
                  "o_orderdate as admit_ts, o_orderdate + interval 3 day as discharge_ts, "
                  "case when c_nationkey = 3 then 'SE Southeast' when c_nationkey = 4 then null else 'Main' end "
                  "as facility from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F'",
}
_USES = {
    "x_index": ["x_event"], "encounter": ["x_admit"], "patients": ["encntr_alias", "encounter"],
    "index_rows": ["patients", "clinical_event", "ce_date_result"], "code_start": ["index_rows"],
    "code_end": ["index_rows"], "intervals": ["patients", "index_rows", "code_start", "code_end"],
    "demo": ["x_admit"], "anchored": ["listed", "ids"], "anchors": ["anchored"], "include": ["anchors", "demo"],
    "numbers": ["measures"],
}


def sql_with(*names: str) -> str:
    """WITH clause that defines the named stand-ins and what they use."""
    order: list[str] = []

    def need(name: str) -> None:
        for used in _USES.get(name, []):
            need(used)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "with " + ",\n".join(f"{n} as ({_SQL.get(n) or _sql_spec(n)})" for n in order) + "\n"


# The same in Spark

def x_anchor(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("anchor_ts"))


def x_admit(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("ts").alias("admit_ts"), F.max("ts").alias("disch_ts"))


def x_cov(spark: SparkSession, folder: str) -> DataFrame:
    n = spark_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("o_orderkey").alias("n")
    )
    return spark_table(spark, folder, "customer").join(n, "c_custkey", "left").select(
        "c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("treated"), "c_acctbal",
        F.coalesce("n", F.lit(0)).alias("n_orders"),
    )


def code_value(spark: SparkSession, folder: str) -> DataFrame:
    nations = spark_table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("code_value"), F.col("n_name").alias("display")
    )
    return nations.unionByName(small_table(spark, _code_rows(), "code_value long, display string"))


def _with_bounds(spark: SparkSession, folder: str) -> DataFrame:
    bounds = x_admit(spark_table(spark, folder, "events")).withColumnRenamed("user_id", "c_custkey")
    return spark_table(spark, folder, "customer").join(bounds, "c_custkey", "left")


def _facility():
    return (
        F.when(F.col("c_nationkey") == 3, "SE Southeast").when(F.col("c_nationkey") == 4, None).otherwise("Main")
    )


def _encounter(spark: SparkSession, folder: str) -> DataFrame:
    return _with_bounds(spark, folder).select(
        F.col("c_custkey").alias("encntr_id"), (F.col("c_custkey") + PERSON).alias("person_id"),
        F.col("admit_ts").alias("reg_dt_tm"), F.col("disch_ts").alias("disch_dt_tm"),
        F.col("c_mktsegment").alias("reason_for_visit"),
    )


def warehouse(spark: SparkSession, folder: str) -> Tables:
    def scan(name: str) -> DataFrame:
        if name == "encounter":
            return _encounter(spark, folder)
        if name == "code_value":
            return code_value(spark, folder)
        return spark_table(spark, folder, "resus_orders" if name == "orders" else name)

    return Tables(scan)


def account_list(spark: SparkSession, folder: str) -> DataFrame:
    return spark_table(spark, folder, "customer").select(F.col("c_name").alias("alias"))


def demographics(spark: SparkSession, folder: str) -> DataFrame:
    return _with_bounds(spark, folder).select(
        F.col("c_custkey").alias("encntr_id"), "admit_ts", F.col("disch_ts").alias("discharge_ts"),
        _facility().alias("facility"),
    )


def visit_demographics(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark_table(spark, folder, "orders").where("o_orderstatus = 'F'")
    customer = spark_table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return orders.join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("encntr_id"), (F.col("o_custkey") % 90).cast("int").alias("age"),
        F.col("o_orderstatus").alias("gender"), F.col("c_mktsegment").alias("race"),
        F.col("o_totalprice").alias("length_stay"), F.lit("Home").alias("disposition"),
        F.col("o_orderdate").alias("admit_ts"), F.expr("o_orderdate + interval 3 day").alias("discharge_ts"),
        _facility().alias("facility"),
    )
