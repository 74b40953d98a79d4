"""Registered queries: one per operator, each over whole given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions import clean, times
from anchorline.operators import batches, cohort, extremes, firsts, index, lookup, matching, readmit, reshape, windows
from anchorline.registry import stand_ins as S
from anchorline.registry.stand_ins import spark_table as table
from anchorline.registry.stand_ins import sql_with
from anchorline.session import configure, stable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOURS = lambda n: timedelta(hours=n)


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that gives the same rows."""
    def keep(query: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return query(configure(spark), folder)

        key = name or query.__name__
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return query

    return keep


def x_index(spark: SparkSession, folder: str) -> DataFrame:
    return index.index_interval(
        table(spark, folder, "x_event"), ["user_id", "parent_id"], "event_type", "ts", "signup", "purchase"
    )


def x_anchor(spark: SparkSession, folder: str) -> DataFrame:
    return S.x_anchor(table(spark, folder, "events"))


def x_admit(spark: SparkSession, folder: str) -> DataFrame:
    return S.x_admit(table(spark, folder, "events"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")


# ---- cohort -----------------------------------------------------------------------------------

@register("""
select distinct o.o_orderkey as encntr_id, o.o_custkey as person_id, cast(o.o_custkey as varchar) as alias
from orders o join customer c on c.c_custkey = o.o_custkey
where c.c_mktsegment = 'BUILDING' and o.o_orderpriority <> '5-LOW'
""")
def cohort_encounters(spark, folder):
    orders = table(spark, folder, "orders")
    alias = orders.selectExpr(
        "o_orderkey as encntr_id", "cast(o_custkey as string) as alias",
        "cast(case when o_orderpriority = '5-LOW' then 1 else 619 end as bigint) as encntr_alias_type_cd",
    )
    encounter = orders.selectExpr("o_orderkey as encntr_id", "o_custkey as person_id")
    ids = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").selectExpr(
        "cast(c_custkey as string) as alias"
    )
    return cohort.resolve_cohort(ids, alias, encounter)


@register("""
with numbered as (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer)
select cast(i // 75 as bigint) as batch, count(*) as n_ids,
       string_agg(cast(c_custkey as varchar), ';' order by c_custkey) as ids
from numbered group by 1
""")
def batch_ids(spark, folder):
    return batches.batch_ids(table(spark, folder, "customer"), "c_custkey")


@register("""
select o.o_orderkey as encntr_id, o.o_totalprice, o.o_orderdate
from orders o where o.o_custkey in (select c_custkey from customer where c_acctbal < 0)
""")
def semi_cohort(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    owing = table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    kept = cohort.restrict(orders, owing, "o_custkey")
    return kept.select(F.col("o_orderkey").alias("encntr_id"), "o_totalprice", "o_orderdate")


@register("""
select c_custkey, c_name, n_orders, last_order from customer left join
  (select o_custkey, count(*) as n_orders, max(o_orderdate) as last_order from orders
   where o_orderstatus = 'F' group by 1) on o_custkey = c_custkey
""")
def attach_facts(spark, folder):
    facts = table(spark, folder, "orders").where("o_orderstatus = 'F'").groupBy(
        F.col("o_custkey").alias("c_custkey")
    ).agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    return cohort.attach(table(spark, folder, "customer").select("c_custkey", "c_name"), facts, "c_custkey")


@register(sql_with("anchored") + """
select encntr_id, fin, code_ts from anchored
qualify row_number() over (partition by encntr_id order by code_ts, fin) = 1
""")
def first_anchor_per_subject(spark, folder):
    from anchorline.plans.analysis import anchors_from_list

    return anchors_from_list(table(spark, folder, "listed"), table(spark, folder, "ids")).select(
        "encntr_id", "fin", "code_ts"
    )


# ---- filters and projections ------------------------------------------------------------------

@register("select o_orderdate as dateordered, o_orderkey as id, o_custkey as person from orders")
def select_rename_lower(spark, folder):
    picked = clean.pick(
        table(spark, folder, "orders"),
        {"ID": "o_orderkey", "Person": "o_custkey", "Status": "o_orderstatus", "DateOrdered": "o_orderdate"},
    )
    return clean.front(clean.rename_lower(picked), ["date*"], drop=["status"])


@register("""
select p_partkey, p_brand, p_type from part
where p_brand = 'Brand#1' or p_brand = 'Brand#12' or p_brand = 'Brand#17' or p_brand = 'Brand#4'
""")
def concept_filter(spark, folder):
    kept = clean.in_concepts("p_brand", ["Brand#1", "Brand#12", "Brand#17", "Brand#4"])
    return table(spark, folder, "part").where(kept).select("p_partkey", "p_brand", "p_type")


@register("""
select p_partkey, p_name from part
where starts_with(p_name, 'small') or contains(p_name, 'bolt') or contains(p_name, 'red ring')
""")
def regex_filter(spark, folder):
    return table(spark, folder, "part").where(clean.matches("p_name", "^small|bolt|red ring")).select(
        "p_partkey", "p_name"
    )


@register("""
select l_orderkey, l_linenumber, l_quantity, l_returnflag, 'narrow' as event_group from lineitem
where l_returnflag = 'A' and l_quantity >= 5 and l_quantity < 40
union all select l_orderkey, l_linenumber, l_quantity, l_returnflag, 'open' from lineitem
where l_returnflag = 'N' and l_quantity > 2
union all select l_orderkey, l_linenumber, l_quantity, l_returnflag, 'all' from lineitem where l_returnflag = 'R'
""")
def plausible_range(spark, folder):
    limits = {"A": ("narrow", 5.0, 40.0, False), "N": ("open", 2.0, None, True), "R": ("all", None, None, False)}
    group = F.lit(None).cast("string")
    for flag, (name, low, high, low_open) in limits.items():
        test = (F.col("l_returnflag") == flag) & clean.within_limits("l_quantity", low, high, low_open)
        group = F.when(test, F.lit(name)).otherwise(group)
    return (
        table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
        .withColumn("event_group", group).where("event_group is not null")
    )


@register("""
select l_orderkey as encntr_id, l_linenumber as line_no, l_partkey as event_cd from lineitem where l_linestatus = 'O'
""")
def current_version(spark, folder):
    return table(spark, folder, "x_measure").where(clean.current_version("valid_until")).select(
        "encntr_id", "line_no", "event_cd"
    )


@register("""
select event_id, nullif(event_type, 'click') as kind, value from events where event_type not in ('error', 'click')
""")
def exclude_value(spark, folder):
    kinds = _events(spark, folder).select("event_id", F.expr("nullif(event_type, 'click')").alias("kind"), "value")
    return clean.exclude_value(kinds, "kind", "error")


@register("""
select l_orderkey as encntr_id, l_partkey as event_cd, p_name as display, l_linestatus as line_status
from lineitem join part on p_partkey = l_partkey where starts_with(p_name, 'red') or l_linestatus = 'F'
""")
def concept_or_class(spark, folder):
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("event_cd"), F.col("p_name").alias("display"))
    measured = table(spark, folder, "x_measure").select(
        "encntr_id", "event_cd", "line_status",
        F.when(F.col("line_status") == "F", 99985).otherwise(159).alias("event_class"),
    )
    return measured.join(names, "event_cd").where(
        clean.concept_or_class("display", "^red", "event_class", 99985)
    ).select("encntr_id", "event_cd", "display", "line_status")


@register(sql_with("x_text") + """
select l_orderkey, l_linenumber, result_val[1] = '<' as censor_low, result_val[1] = '>' as censor_high,
       case when result_val in ('<5', '>45', 'n/a', '7d') then null else cast(result_val as double) end as result_val
from (select l_orderkey, l_linenumber, result_val from x_text)
""".replace("cast(result_val as double)", "try_cast(result_val as double)"))
def censored_numeric(spark, folder):
    return clean.censored_number(table(spark, folder, "x_text"), "result_val")


@register("""
with rules as (
  select c_custkey, case when c_nationkey % 2 = 0 then null
         else timestamp '1997-01-01 00:00:00' + (c_custkey % 365) * interval 1 day end as only_start
  from customer where c_acctbal < 5000)
select o_orderkey, o_custkey, o_orderdate as start_date,
       case when c_custkey is not null and (only_start is null or only_start = o_orderdate)
            then timestamp '2001-01-01 00:00:00' else o_orderdate end as end_date
from orders left join rules on c_custkey = o_custkey
""")
def date_override(spark, folder):
    rules = table(spark, folder, "customer").where("c_acctbal < 5000").selectExpr(
        "c_custkey as o_custkey",
        "case when c_nationkey % 2 = 0 then null else cast(timestamp '1997-01-01 00:00:00' as timestamp_ntz) "
        "+ (c_custkey % 365) * interval 1 day end as start_date",
        "cast(timestamp '2001-01-01 00:00:00' as timestamp_ntz) as fixed_end",
    )
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderdate as start_date", "o_orderdate as end_date"
    )
    return clean.override(orders, rules, ["o_custkey"], "end_date", "fixed_end", only_when="start_date")


@register("""
with rules as (
  select c_custkey, 1 as rank, timestamp '1996-01-01 00:00:00' + (c_custkey % 365) * interval 1 day as only_start,
         timestamp '2003-01-01 00:00:00' as fixed from customer where c_custkey % 3 = 0
  union all select c_custkey, 2, null, timestamp '2001-01-01 00:00:00' from customer where c_custkey % 2 = 0
  union all select c_custkey, 3, null, timestamp '2002-01-01 00:00:00' from customer where c_custkey % 5 = 0)
select o_orderkey, o_custkey, o_orderdate as start_date, coalesce(
  (select arg_min(fixed, rank) from rules where c_custkey = o_custkey and (only_start is null or only_start = o_orderdate)),
  o_orderdate) as end_date
from orders
""")
def override_overlapping(spark, folder):
    """Several rules fit one order: the first one counts, and no row is doubled."""
    customers = table(spark, folder, "customer")
    rule = lambda where, rank, only, fixed: customers.where(where).selectExpr(
        "c_custkey as o_custkey", f"{rank} as rank", f"cast({only} as timestamp_ntz) as start_date",
        f"cast('{fixed}' as timestamp_ntz) as fixed_end",
    )
    rules = rule(
        "c_custkey % 3 = 0", 1, "cast('1996-01-01' as timestamp_ntz) + (c_custkey % 365) * interval 1 day", "2003-01-01"
    ).unionAll(rule("c_custkey % 2 = 0", 2, "null", "2001-01-01")).unionAll(
        rule("c_custkey % 5 = 0", 3, "null", "2002-01-01")
    )
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderdate as start_date", "o_orderdate as end_date"
    )
    return clean.override(orders, rules, ["o_custkey"], "end_date", "fixed_end", only_when="start_date", rank="rank")


@register(sql_with("x_anchor") + """
select event_id, e.user_id, ts, anchor_ts, ts < anchor_ts as pre_code from events e join x_anchor a
on a.user_id = e.user_id
""")
def pre_post_flag(spark, folder):
    joined = _events(spark, folder).select("event_id", "user_id", "ts").join(x_anchor(spark, folder), "user_id")
    return joined.withColumn("pre_code", clean.is_before("ts", "anchor_ts"))


# ---- index events -----------------------------------------------------------------------------

@register(sql_with("x_index") + "select user_id, parent_id, start_ts, stop_ts from x_index")
def index_interval(spark, folder):
    return x_index(spark, folder)


@register(sql_with("x_index") + """
select user_id, min(start_ts) as first_start_ts from x_index where start_ts is not null group by user_id
""")
def first_index(spark, folder):
    return index.first_index(x_index(spark, folder), "user_id")


@register(sql_with("x_event") + """
, members as (select c_custkey as user_id from customer),
groups as (select distinct user_id, parent_id from x_event where event_type in ('signup', 'purchase')),
starts as (select parent_id, min(ts) as t from x_event where event_type = 'signup' group by 1),
stops as (select parent_id, max(ts) as t from x_event where event_type = 'purchase' group by 1)
select distinct m.user_id, g.parent_id, timezone('US/Central', timezone('UTC', s.t)) as start_local,
       timezone('US/Central', timezone('UTC', e.t)) as stop_local
from members m left join groups g on g.user_id = m.user_id left join starts s on s.parent_id = g.parent_id
left join stops e on e.parent_id = g.parent_id
""")
def index_interval_outer(spark, folder):
    members = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    outer = index.index_interval_outer(members, stable(x_index(spark, folder)), "user_id", "parent_id")
    return outer.select(
        "user_id", "parent_id", times.to_local("start_ts").alias("start_local"),
        times.to_local("stop_ts").alias("stop_local"),
    )


# ---- joins ------------------------------------------------------------------------------------

@register("""
select o_orderkey, o_custkey, l_linenumber, l_shipdate
from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 25
""")
def left_with_on_predicate(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    wanted = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)
    return lookup.left_with_condition(orders, lines, ["o_orderkey"], wanted).select(
        "o_orderkey", "o_custkey", "l_linenumber", "l_shipdate"
    )


@register("""
with anchored as (select c_custkey, timestamp '1995-06-01 00:00:00' + (c_custkey % 1000) * interval 1 day as anchor_ts
                  from customer)
select c_custkey, anchor_ts, o_orderkey, o_orderdate from anchored
left join orders on o_custkey = c_custkey and o_orderdate < anchor_ts and o_orderpriority in ('1-URGENT', '2-HIGH')
""")
def outer_inequality(spark, folder):
    anchored = table(spark, folder, "customer").selectExpr(
        "c_custkey",
        "cast(timestamp '1995-06-01 00:00:00' as timestamp_ntz) + (c_custkey % 1000) * interval 1 day as anchor_ts",
    )
    urgent = table(spark, folder, "orders").where(
        clean.in_concepts("o_orderpriority", ["1-URGENT", "2-HIGH"])
    ).selectExpr("o_custkey as c_custkey", "o_orderkey", "o_orderdate")
    return lookup.outer_before(anchored, urgent, ["c_custkey"], "o_orderdate", "anchor_ts")


@register(sql_with("x_index") + """
, first_start as (select user_id, min(start_ts) as t from x_index where start_ts is not null group by 1),
earlier as (select e.user_id, e.ts, e.event_type || ' ' || cast(cast(floor(e.value) as int) as varchar) as status,
            rank() over (partition by e.user_id order by date_trunc('hour', e.ts) desc) as r
            from events e join first_start f on f.user_id = e.user_id where e.ts < f.t)
select user_id, max(status) as last_status from earlier where r = 1 group by user_id
""")
def last_status_before_index(spark, folder):
    first = index.first_index(x_index(spark, folder), "user_id")
    charted = _events(spark, folder).selectExpr(
        "user_id", "ts", "cast(date_trunc('hour', ts) as timestamp_ntz) as hour_ts",
        "event_type || ' ' || cast(cast(floor(value) as int) as string) as status",
    )
    earlier = windows.before_bound(charted, first, ["user_id"], "ts", "first_start_ts")
    return firsts.keep_last(earlier, ["user_id"], "hour_ts", {"last_status": "status"})


@register(sql_with("x_index") + """
select x.event_id, x.user_id, x.ts, x.value, i.parent_id as index_parent from x_event x join x_index i
on i.user_id = x.user_id and x.ts between i.start_ts - interval 6 hour and i.stop_ts + interval 12 hour
where x.event_type in ('click', 'view')
""")
def window_interval(spark, folder):
    measures = table(spark, folder, "x_event").where(clean.in_concepts("event_type", ["click", "view"])).select(
        "event_id", "user_id", "ts", "value"
    )
    found = windows.in_interval_window(
        measures, x_index(spark, folder).withColumnRenamed("parent_id", "index_parent"), ["user_id"], "ts",
        "start_ts", "stop_ts", HOURS(6), HOURS(12),
    )
    return found.select("event_id", "user_id", "ts", "value", "index_parent")


@register(sql_with("x_anchor") + """
select event_id, e.user_id, ts, value, anchor_ts from events e join x_anchor a on a.user_id = e.user_id
and ts >= anchor_ts and ts <= anchor_ts
    + case when a.user_id % 10 = 0 then interval 200 year when a.user_id % 10 = 1 then interval 3 day else interval 40 minute end
""")
def window_open_interval(spark, folder):
    """A tenth of the stops lies 200 years off, as a mistyped date does."""
    anchors = x_anchor(spark, folder).withColumn("stop_ts", F.expr(
        "case when user_id % 10 = 0 then anchor_ts + interval 200 year "
        "when user_id % 10 = 1 then anchor_ts + interval 3 day else anchor_ts + interval 40 minute end"
    ))
    measures = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return windows.in_interval_window(
        measures, anchors.select("user_id", "anchor_ts", "stop_ts"), ["user_id"], "ts", "anchor_ts", "stop_ts",
        width=HOURS(1),
    ).select("event_id", "user_id", "ts", "value", "anchor_ts")


@register(sql_with("x_anchor") + """
select event_id, e.user_id, event_type, ts, value from events e join x_anchor a on a.user_id = e.user_id
where ts >= anchor_ts - interval 24 hour and ts <= anchor_ts + interval 24 hour
""")
def window_point(spark, folder):
    found = windows.in_point_window(
        _events(spark, folder), x_anchor(spark, folder), ["user_id"], "ts", "anchor_ts", HOURS(24), HOURS(24)
    )
    return found.select("event_id", "user_id", "event_type", "ts", "value")


@register(sql_with("x_anchor") + """
select event_id, e.user_id, ts from events e join x_anchor a on a.user_id = e.user_id where ts < anchor_ts
""")
def before_bound(spark, folder):
    return windows.before_bound(
        _events(spark, folder), x_anchor(spark, folder), ["user_id"], "ts", "anchor_ts"
    ).select("event_id", "user_id", "ts")


@register(sql_with("x_anchor") + """
select event_id, e.user_id, ts from events e join x_anchor a on a.user_id = e.user_id
where event_type = 'error' and ts >= anchor_ts
""")
def from_bound(spark, folder):
    return windows.from_bound(
        _events(spark, folder).where("event_type = 'error'"), x_anchor(spark, folder), ["user_id"], "ts", "anchor_ts"
    ).select("event_id", "user_id", "ts")


@register(sql_with("x_admit") + """
select event_id, e.user_id, ts, value from events e join x_admit a on a.user_id = e.user_id
where ts <= admit_ts + interval 24 hour
""")
def first_24h(spark, folder):
    admits = x_admit(spark, folder).select("user_id", "admit_ts")
    return windows.first_hours(_events(spark, folder), admits, ["user_id"], "ts", "admit_ts").select(
        "event_id", "user_id", "ts", "value"
    )


@register(sql_with("x_anchor", "x_stay") + """
select s.event_id, s.user_id, s.unit, s.arrive_ts, s.depart_ts,
       a.anchor_ts >= s.arrive_ts and a.anchor_ts <= s.depart_ts as covers,
       (epoch_us(s.arrive_ts) - epoch_us(a.anchor_ts))::double / 3600e6 as hours_after
from x_stay s join x_anchor a on a.user_id = s.user_id where s.depart_ts <= timestamp '2024-01-29 00:00:00'
and ((s.arrive_ts <= a.anchor_ts and a.anchor_ts <= s.depart_ts)
     or (s.arrive_ts > a.anchor_ts and s.arrive_ts <= a.anchor_ts + interval 2 hour))
""")
def stay_at_index(spark, folder):
    ended = table(spark, folder, "x_stay").where("depart_ts <= timestamp_ntz '2024-01-29 00:00:00'")
    return windows.stay_at_anchor(
        ended, x_anchor(spark, folder), ["user_id"], "arrive_ts", "depart_ts", "anchor_ts"
    ).select("event_id", "user_id", "unit", "arrive_ts", "depart_ts", "covers", "hours_after")


@register(sql_with("x_anchor") + """
, earlier as (select e.user_id, event_type, ts, value, event_id, row_number() over
  (partition by e.user_id, event_type order by ts desc, event_id) as r
  from events e join x_anchor a on a.user_id = e.user_id where ts < anchor_ts)
select user_id, event_type, ts, value from earlier where r = 1
""")
def last_before_index(spark, folder):
    return windows.last_before(
        _events(spark, folder), x_anchor(spark, folder), ["user_id"], "ts", "anchor_ts", ["user_id", "event_type"],
        ["event_id"],
    ).select("user_id", "event_type", "ts", "value")


@register("""
with a as (select user_id, count(*) as n_clicks from events where event_type = 'click' group by 1),
b as (select user_id, max(value) as top_view from events where event_type = 'view' group by 1),
c as (select c_custkey as user_id, true as flagged from customer where c_acctbal < 0)
select coalesce(a.user_id, b.user_id, c.user_id) as user_id, n_clicks, top_view, coalesce(flagged, false) as flagged
from a full join b on b.user_id = a.user_id full join c on c.user_id = coalesce(a.user_id, b.user_id)
""")
def full_outer_assembly(spark, folder):
    events = _events(spark, folder)
    clicks = events.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n_clicks"))
    views = events.where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("top_view"))
    flagged = table(spark, folder, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("user_id"), F.lit(True).alias("flagged")
    )
    return clean.dense_booleans(reshape.full_outer([clicks, views, flagged], "user_id"))


@register("""
select l_orderkey, l_linenumber, o_custkey, p_name as part_name, n_name as nation_name
from lineitem join orders on o_orderkey = l_orderkey left join part on p_partkey = l_partkey and p_size > 10
left join supplier on s_suppkey = l_suppkey left join nation on n_nationkey = s_nationkey
""")
def code_lookup(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, folder, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey")
    parts = table(spark, folder, "part").where("p_size > 10").selectExpr("p_partkey as code_value", "p_name as display")
    makers = table(spark, folder, "supplier").selectExpr("s_suppkey as code_value", "s_nationkey as display")
    nations = table(spark, folder, "nation").selectExpr("n_nationkey as code_value", "n_name as display")
    named = lookup.with_display(lines.join(orders, "l_orderkey"), parts, {"l_partkey": "part_name"})
    named = lookup.with_display(named, makers, {"l_suppkey": "nation_cd"})
    return lookup.with_display(named, nations, {"nation_cd": "nation_name"}).select(
        "l_orderkey", "l_linenumber", "o_custkey", "part_name", "nation_name"
    )


@register(sql_with("x_index") + """
select x.event_id, x.parent_id, x.event_type, i.start_ts from x_event x join x_index i on i.parent_id = x.parent_id
where i.start_ts is not null
""")
def sibling_events(spark, folder):
    started = x_index(spark, folder).where("start_ts is not null").select("parent_id", "start_ts")
    events = table(spark, folder, "x_event").select("event_id", "parent_id", "event_type")
    return lookup.sibling_events(started, events, "parent_id").select(
        "event_id", "parent_id", "event_type", "start_ts"
    )


# ---- first and last values --------------------------------------------------------------------

def _ranked_sql(keys: str, values: str, direction: str, extra: str = "") -> str:
    return sql_with("x_measure") + (
        f", ranked as (select *, rank() over (partition by {keys} order by event_end {direction}) as r "
        f"from x_measure) select {keys}, {extra} {values} from ranked where r = 1 group by {keys}"
    )


@register(_ranked_sql("encntr_id", "max(result_val) as first_val, max(unit) as first_unit", "asc nulls last"))
def keep_first(spark, folder):
    return firsts.keep_first(
        table(spark, folder, "x_measure"), ["encntr_id"], "event_end", {"first_val": "result_val", "first_unit": "unit"}
    )


@register(_ranked_sql("encntr_id", "max(result_val) as last_val, max(unit) as last_unit", "desc nulls first"))
def keep_last(spark, folder):
    return firsts.keep_last(
        table(spark, folder, "x_measure"), ["encntr_id"], "event_end", {"last_val": "result_val", "last_unit": "unit"}
    )


_BRANDED = sql_with("x_measure") + (
    ", known as (select m.*, p.p_brand as category from x_measure m join part p on p.p_partkey = m.event_cd)"
)


@register(_BRANDED + """
, ranked as (select *, rank() over (partition by encntr_id, category, unit order by event_end) as r from known)
select encntr_id, category, unit, min(event_end) as event_end, max(event_cd) as event_cd,
       max(result_val) as result_val from ranked where r = 1 group by encntr_id, category, unit
""")
def first_per_category(spark, folder):
    brands = table(spark, folder, "part").select(
        F.col("p_partkey").alias("event_cd"), F.col("p_brand").alias("category")
    )
    return firsts.keep_first(
        table(spark, folder, "x_measure").join(brands, "event_cd"), ["encntr_id", "category", "unit"], "event_end",
        {"event_cd": "event_cd", "result_val": "result_val"}, time_as="event_end",
    )


@register(_ranked_sql("encntr_id, event_cd, unit", "max(result_val) as result_val", "asc",
                      "min(event_end) as event_end,"))
def first_per_concept(spark, folder):
    return firsts.keep_first(
        table(spark, folder, "x_measure"), ["encntr_id", "event_cd", "unit"], "event_end",
        {"result_val": "result_val"}, time_as="event_end",
    ).select("encntr_id", "event_cd", "unit", "event_end", "result_val")


@register(_BRANDED + """
, cat as (select *, rank() over (partition by encntr_id, category order by event_end) as r from known
          where category in ('Brand#1', 'Brand#2', 'Brand#3')),
con as (select *, rank() over (partition by encntr_id, event_cd order by event_end) as r from known
        where category in ('Brand#3', 'Brand#4'))
select encntr_id, min(event_end) as event_end, max(event_cd) as event_cd, max(result_val) as result_val
from cat where r = 1 group by encntr_id, category
union
select encntr_id, min(event_end), event_cd, max(result_val) from con where r = 1 group by encntr_id, event_cd
""")
def baseline_union(spark, folder):
    brands = table(spark, folder, "part").select(
        F.col("p_partkey").alias("event_cd"), F.col("p_brand").alias("category")
    )
    known = table(spark, folder, "x_measure").join(brands, "event_cd")
    shape = ["encntr_id", "event_end", "event_cd", "result_val"]
    by_category = firsts.keep_first(
        known.where(clean.in_concepts("category", ["Brand#1", "Brand#2", "Brand#3"])), ["encntr_id", "category"],
        "event_end", {"event_cd": "event_cd", "result_val": "result_val"}, time_as="event_end",
    ).select(*shape)
    by_concept = firsts.keep_first(
        known.where(clean.in_concepts("category", ["Brand#3", "Brand#4"])), ["encntr_id", "event_cd"],
        "event_end", {"result_val": "result_val"}, time_as="event_end",
    ).select(*shape)
    return reshape.union_distinct([by_category, by_concept])


@register("""
select * from (select event_id, user_id, event_type, ts, value,
  row_number() over (partition by user_id, event_type order by ts, event_id) as r from events)
  where r = 1
""".replace("select * from", "select event_id, user_id, event_type, ts, value from"))
def first_row_per_concept(spark, folder):
    return firsts.first_row_per_concept(_events(spark, folder), "user_id", "event_type", "ts", ["event_id"])


@register("select distinct on (user_id) event_id, user_id, event_type, ts, value from events "
          "order by user_id, ts, event_id")
def first_row_per_subject(spark, folder):
    return firsts.first_row_per_subject(_events(spark, folder), "user_id", "ts", ["event_id"])


@register("""
select l_orderkey, l_linenumber, min(l_quantity) as l_quantity,
       min(l_extendedprice) filter (l_quantity = q) as l_extendedprice
from (select *, min(l_quantity) over (partition by l_orderkey, l_linenumber) as q from lineitem)
group by l_orderkey, l_linenumber
""")
def dedupe_first(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return firsts.dedupe_first(lines, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@register(sql_with("x_admit") + """
select e.user_id, event_type, min(value) as min, max(value) as max from events e join x_admit a
on a.user_id = e.user_id where ts <= admit_ts + interval 24 hour group by e.user_id, event_type
""")
def minmax_first_24h(spark, folder):
    admits = x_admit(spark, folder).select("user_id", "admit_ts")
    early = windows.first_hours(_events(spark, folder), admits, ["user_id"], "ts", "admit_ts")
    return extremes.minmax(early, ["user_id", "event_type"], "value")


# ---- reshaping --------------------------------------------------------------------------------

KINDS = ["click", "error", "purchase", "signup", "view"]


@register("select event_id, user_id, ts, " + ", ".join(
    f"max(value) filter (event_type = '{k}') as {k}" for k in KINDS
) + " from events group by event_id, user_id, ts")
def pivot_values(spark, folder):
    return reshape.pivot_values(
        _events(spark, folder), ["event_id", "user_id", "ts"], "event_type", "value", KINDS, strict=True
    )


@register("""
select user_id, coalesce(bool_or(event_type = 'click'), false) as click,
       coalesce(bool_or(event_type = 'error'), false) as error from events
where value > 30 and event_type in ('click', 'error') group by user_id
""")
def presence_pivot(spark, folder):
    high = _events(spark, folder).where((F.col("value") > 30) & clean.in_concepts("event_type", ["click", "error"]))
    return clean.dense_booleans(reshape.presence_pivot(high, ["user_id"], "event_type", ["click", "error"]))


@register("""
select distinct event_type as event from events union all select distinct p_type from part
union all select distinct o_orderpriority from orders
""")
def vocabulary(spark, folder):
    return reshape.vocabulary(
        [
            (table(spark, folder, "events"), "event_type"), (table(spark, folder, "part"), "p_type"),
            (table(spark, folder, "orders"), "o_orderpriority"),
        ]
    )


@register("""
select event_id as id, user_id as subject, value, null::timestamp as shipped from events
union all select l_orderkey, null, l_quantity, l_shipdate from lineitem
""")
def stacked_sets(spark, folder):
    events = table(spark, folder, "events").selectExpr("event_id as id", "user_id as subject", "value")
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as id", "l_quantity as value", "l_shipdate as shipped"
    )
    return reshape.stack([events, lines])


# ---- fill-down and readmissions ---------------------------------------------------------------

@register(sql_with("x_visit") + """
select person_id, encntr_id, admit_ts, last_value(index_ts ignore nulls) over w as index_ts,
       last_value(index_mark ignore nulls) over w as index_mark
from (select *, case when index_ts is not null then encntr_id end as index_mark from x_visit)
window w as (partition by person_id order by admit_ts, encntr_id rows between unbounded preceding and current row)
""")
def locf(spark, folder):
    visits = table(spark, folder, "x_visit").select("person_id", "encntr_id", "admit_ts", "index_ts").withColumn(
        "index_mark", F.when(F.col("index_ts").isNotNull(), F.col("encntr_id"))
    )
    return readmit.locf(visits, ["person_id"], "admit_ts", ["encntr_id"], ["index_ts", "index_mark"])


@register(sql_with("x_visit") + """
, filled as (select person_id, encntr_id, admit_ts, disposition, last_value(index_ts ignore nulls) over w as index_ts,
  last_value(case when index_ts is not null then encntr_id end ignore nulls) over w as index_id from x_visit
  window w as (partition by person_id order by admit_ts, encntr_id rows between unbounded preceding and current row))
select person_id, encntr_id, admit_ts, index_id, (epoch_us(admit_ts) - epoch_us(index_ts))::double / 86400e6
       as readmit_days
from filled where disposition <> '5-LOW' and admit_ts > index_ts and admit_ts <= index_ts + interval 30 day
""")
def readmissions(spark, folder):
    return readmit.readmissions(
        table(spark, folder, "x_visit"), "person_id", "encntr_id", "admit_ts", "index_ts", "disposition", "5-LOW"
    ).select("person_id", "encntr_id", "admit_ts", "index_id", "readmit_days")


# ---- time functions ---------------------------------------------------------------------------

@register("""
select event_id, timezone('US/Central', timezone('UTC', ts)) as local_ts,
       timezone('US/Central', timezone('UTC', ts + interval 70 day)) as later_ts from events
""")
def local_time(spark, folder):
    return _events(spark, folder).select(
        "event_id", times.to_local("ts").alias("local_ts"),
        times.to_local(F.expr("ts + interval 70 day")).alias("later_ts"),
    )


@register("""
select l_orderkey, l_linenumber, e.event_id, date_trunc('day', l_shipdate) + (e.ts - date_trunc('day', e.ts)) as composed, year(e.ts) as y, month(e.ts) as m, day(e.ts) as d, hour(e.ts) as h,
       minute(e.ts) as mi, second(e.ts) as s
from lineitem left join events e on e.event_id = l_orderkey
""")
def compose_timestamp(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_shipdate")
    events = table(spark, folder, "events").selectExpr("event_id", "ts")
    joined = lines.join(events, F.col("event_id") == F.col("l_orderkey"), "left")
    parts = {"y": F.year, "m": F.month, "d": F.dayofmonth, "h": F.hour, "mi": F.minute, "s": F.second}
    return joined.select(
        "l_orderkey", "l_linenumber", "event_id", times.compose("l_shipdate", "ts").alias("composed"),
        *(f("ts").cast("long").alias(n) for n, f in parts.items()),
    )


@register("""
select l_orderkey, l_linenumber, l_shipdate, (epoch_us(l_shipdate) - epoch_us(o_orderdate))::double / 86400e6 as days,
       (epoch_us(l_shipdate) - epoch_us(o_orderdate))::double / 3600e6 as hours,
       (epoch_us(l_shipdate) - epoch_us(o_orderdate))::double / 60e6 as mins
from lineitem join orders on o_orderkey = l_orderkey
""")
def elapsed(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, folder, "orders").selectExpr("o_orderkey as l_orderkey", "o_orderdate")
    return lines.join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_shipdate", times.elapsed("l_shipdate", "o_orderdate", "days").alias("days"),
        times.elapsed("l_shipdate", "o_orderdate", "hours").alias("hours"),
        times.elapsed("l_shipdate", "o_orderdate", "minutes").alias("mins"),
    )


@register(sql_with("x_admit", "person") + f"""
select a.user_id, (epoch_us(disch_ts) - epoch_us(admit_ts))::double / 86400e6 as los,
  cast(trunc((epoch_us(timezone('US/Central', timezone('UTC', admit_ts))) - epoch_us(birth_dt_tm))::double
       / 86400e6 / 365.25::double) as int) as age
from x_admit a join person p on p.person_id = a.user_id + {S.PERSON}
""")
def age_los(spark, folder):
    people = table(spark, folder, "person").select((F.col("person_id") - S.PERSON).alias("user_id"), "birth_dt_tm")
    return x_admit(spark, folder).join(people, "user_id").select(
        "user_id", times.elapsed("disch_ts", "admit_ts").alias("los"),
        times.whole_years(times.to_local("admit_ts"), "birth_dt_tm").alias("age"),
    )


# ---- matching ---------------------------------------------------------------------------------

@register(sql_with("x_cov") + """
select c_custkey, treated, c_acctbal, n_orders from x_cov where case when treated
  then c_acctbal between (select min(c_acctbal) from x_cov where not treated)
                     and (select max(c_acctbal) from x_cov where not treated)
  else c_acctbal between (select min(c_acctbal) from x_cov where treated)
                     and (select max(c_acctbal) from x_cov where treated) end
""")
def common_support(spark, folder):
    return matching.common_support(S.x_cov(spark, folder), "treated", "c_acctbal")


@register(sql_with("x_cov") + ", tall as (select treated, 'c_acctbal' as variable, c_acctbal as x from x_cov "
          "union all select treated, 'n_orders', cast(n_orders as double) from x_cov) " + """
select 'all' as sample, variable, round(avg(x) filter (treated), 6) as mean_treated,
       round(avg(x) filter (not treated), 6) as mean_control,
       round(stddev_samp(x) filter (not treated), 6) as sd_control,
       round(avg(x) filter (treated) - avg(x) filter (not treated), 6) as mean_diff,
       round((avg(x) filter (treated) - avg(x) filter (not treated)) / stddev_samp(x) filter (treated), 6)
       as std_mean_diff
from tall group by variable
""")
def balance_summary(spark, folder):
    summary = matching.balance_summary(S.x_cov(spark, folder), "treated", ["c_acctbal", "n_orders"])
    numbers = ["mean_treated", "mean_control", "sd_control", "mean_diff", "std_mean_diff"]
    return summary.select("sample", "variable", *(F.round(c, 6).alias(c) for c in numbers))


# The likelihood fit by 25 Newton steps, the 3 x 3 system solved by Cramer's rule
_FIT = """
, obs as materialized (select c_custkey, treated, treated::int::double as y, c_acctbal as x1, n_orders::double as x2
  from x_cov),
fit(step, b0, b1, b2) as (
  select 0, 0::double, 0::double, 0::double
  union all
  select step + 1,
    b0 + (g0*(s11*s22 - s12*s12) - s01*(g1*s22 - s12*g2) + s02*(g1*s12 - s11*g2)) / det,
    b1 + (s00*(g1*s22 - s12*g2) - g0*(s01*s22 - s12*s02) + s02*(s01*g2 - g1*s02)) / det,
    b2 + (s00*(s11*g2 - g1*s12) - s01*(s01*g2 - g1*s02) + g0*(s01*s12 - s11*s02)) / det
  from (select *, s00*(s11*s22 - s12*s12) - s01*(s01*s22 - s12*s02) + s02*(s01*s12 - s11*s02) as det from (
    select step, b0, b1, b2, sum(w) as s00, sum(w*x1) as s01, sum(w*x2) as s02, sum(w*x1*x1) as s11,
           sum(w*x1*x2) as s12, sum(w*x2*x2) as s22, sum(y-p) as g0, sum((y-p)*x1) as g1, sum((y-p)*x2) as g2
    from (select *, p*(1-p) as w from (
      select fit.*, obs.*, 1 / (1 + exp(-(b0 + b1*x1 + b2*x2))) as p from fit, obs where step < 25))
    group by step, b0, b1, b2))),
scored as materialized (select c_custkey, treated, x1, x2, 1 / (1 + exp(-(b0 + b1*x1 + b2*x2))) as score
  from obs, fit where step = 25)
"""


def _pairs_sql(scored: str, nobody: str = "-1::bigint") -> str:
    """One turn per treated unit; `scored` has c_custkey, treated and score. Controls that are taken are a keyed table
    that grows by one row a turn; `nobody` is an id of the right type that no unit has."""
    return f"""
, kept as materialized (select c_custkey as id, treated, score as s from {scored} where case when treated
  then score between (select min(score) from {scored} where not treated)
                 and (select max(score) from {scored} where not treated)
  else score between (select min(score) from {scored} where treated)
                 and (select max(score) from {scored} where treated) end),
queue as materialized (select id, s, row_number() over (order by s desc, id) as turn from kept where treated),
controls as materialized (select id, s from kept where not treated),
pick(control_id, turn, treated_id, distance) using key (control_id) as (
  select {nobody}, 0::bigint, {nobody}, null::double
  union
  select best.id, turn, tid, best.d from (
    select q.turn, q.id as tid,
           arg_min({{'id': c.id, 'd': abs(c.s - q.s)}}, {{'d': abs(c.s - q.s), 's': -c.s, 'id': c.id}}) as best
    from pick p join queue q on q.turn = p.turn + 1
    join controls c on not exists (select 1 from recurring.pick t where t.control_id = c.id)
    group by q.turn, q.id)),
pairs as (select treated_id, control_id, distance from pick where turn > 0)
"""


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


BY_BALANCE = recursive(sql_with("x_cov")) + ", plain as (select c_custkey, treated, c_acctbal as score from x_cov)" + (
    _pairs_sql("plain")
)
BY_SCORE = recursive(sql_with("x_cov")) + _FIT + _pairs_sql("scored")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    units = S.x_cov(spark, folder)
    matching.require_units(units, "c_custkey", ["treated", "c_acctbal", "n_orders"])
    return matching.propensity_scores(units, "treated", ["c_acctbal", "n_orders"])


@register(recursive(sql_with("x_cov")) + _FIT + "select c_custkey, treated, round(score, 6) as distance from scored")
def propensity_scores(spark, folder):
    return _scored(spark, folder).select("c_custkey", "treated", F.round("distance", 6).alias("distance"))


@register(BY_BALANCE + "select * from pairs")
def greedy_match(spark, folder):
    kept = matching.common_support(S.x_cov(spark, folder), "treated", "c_acctbal")
    return matching.greedy_match(kept, "c_custkey", "treated", "c_acctbal")


@register(BY_BALANCE + """
select x.*, 1.0::double as weights from x_cov x
where c_custkey in (select treated_id from pairs union all select control_id from pairs)
""")
def matched_sample(spark, folder):
    kept = matching.common_support(S.x_cov(spark, folder), "treated", "c_acctbal")
    return matching.matched_sample(kept, matching.greedy_match(kept, "c_custkey", "treated", "c_acctbal"), "c_custkey")
