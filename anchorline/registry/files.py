"""Registered round trips: given tables written to files in the shared folder, and read back by the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.operators import matching
from anchorline.registry import stand_ins as S
from anchorline.registry.operators import register
from anchorline.registry.stand_ins import spark_table as table
from anchorline.registry.stand_ins import sql_with
from anchorline.session import scratch_path
from anchorline.sources import extracts, sinks
from anchorline.sources.warehouse import SCHEMAS, load


@register("""
select c_custkey, c_name, c_acctbal, c_mktsegment from customer
union all select s_suppkey, s_name, s_acctbal, 'supplier' from supplier
""")
def read_extracts(spark, folder):
    """Plain and gzipped files of one prefix, in subfolders."""
    path, schema = scratch_path(spark, "extract"), "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    suppliers = table(spark, folder, "supplier").selectExpr(
        "s_suppkey as c_custkey", "s_name as c_name", "s_acctbal as c_acctbal", "'supplier' as c_mktsegment"
    )
    customers.write.option("header", True).csv(f"{path}/plain")
    suppliers.write.option("header", True).option("compression", "gzip").csv(f"{path}/packed")
    return extracts.read_extract(spark, path, "part-", schema, recursive=True)


@register("""
select l_orderkey, l_linenumber, l_returnflag, cast(date_trunc('day', l_shipdate) as date) as shipped from lineitem
""")
def read_typed(spark, folder):
    """Dates written and read as M/d/yyyy; a line that does not fit would fail the query."""
    path = scratch_path(spark, "typed")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_shipdate").cast("date").alias("shipped")
    )
    lines.write.option("header", True).option("dateFormat", "M/d/yyyy").csv(path)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    return extracts.require_clean(
        extracts.read_typed_csv(spark, path, ", ".join(f"{n} {kind}" for n, kind in kinds.items()))
    )


@register("select p_partkey as id, p_name as name, p_retailprice as price from part")
def read_positional(spark, folder):
    """Columns are named by their place, whatever the header says."""
    path = scratch_path(spark, "positional")
    table(spark, folder, "part").selectExpr("p_partkey as `Some Id`", "p_name as price", "p_retailprice as `2`").write.option(
        "header", True
    ).csv(path)
    return extracts.read_positional(spark, path, "id long, name string, price double")


@register("select event_id, user_id, value, event_type from events")
def write_groups(spark, folder):
    """One folder of gzipped files for each kind of event."""
    path = scratch_path(spark, "groups")
    events = table(spark, folder, "events").select("event_id", "user_id", "value", "event_type")
    sinks.write_groups(events, path, by="event_type")
    return (
        spark.read.schema("event_id long, user_id long, value double, event_type string").option("header", True).csv(path)
        .select(events.columns)
    )


@register("""
select 'orders' as dataset, count(*) as n, sum(o_orderkey)::bigint as keys from orders
union all select 'customer', count(*), sum(c_custkey)::bigint from customer
union all select 'part', count(*), sum(p_partkey)::bigint from part
""")
def write_datasets(spark, folder):
    """Several named tables in one folder."""
    names = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}
    frames = {name: table(spark, folder, name) for name in names}
    written = sinks.write_datasets(frames, scratch_path(spark, "sets"))
    parts = [
        spark.read.parquet(written[name]).agg(F.count("*").alias("n"), F.sum(key).cast("long").alias("keys"))
        .select(F.lit(name).alias("dataset"), "n", "keys") for name, key in names.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


#: What stands for a column of each type in a sum that both engines form exactly.
_SPARK_SUM = {"long": "{c} % 1000003", "double": "cast(round({c} * 100) as bigint)", "string": "length({c})",
              "timestamp_ntz": "unix_micros(cast({c} as timestamp)) % 1000003"}
_SQL_SUM = {**_SPARK_SUM, "timestamp_ntz": "epoch_us({c}) % 1000003"}


def _columns() -> list[tuple[str, str, str]]:
    return [(name, *field.split()) for name, ddl in SCHEMAS.items() for field in ddl.split(", ")]


@register(sql_with(*("resus_orders" if name == "orders" else name for name in SCHEMAS)) + " union all ".join(
    f"select '{name}' as name, '{c}' as field, count(*) as n, count({c}) as present, "
    f"sum({_SQL_SUM[kind].format(c=c)})::bigint as total from {'resus_orders' if name == 'orders' else name}"
    for name, c, kind in _columns()
))
def load_warehouse(spark, folder):
    """All nine warehouse tables written, read with their declared schemas and summed up, one row for each column."""
    given = S.warehouse(spark, folder)
    path = scratch_path(spark, "warehouse")
    for name in SCHEMAS:
        getattr(given, name).write.parquet(f"{path}/{name}")
    tables, parts = load(spark, path), []
    for name in SCHEMAS:
        fields = [(c, kind) for of, c, kind in _columns() if of == name]
        sums = [F.count("*").alias("n")]
        for c, kind in fields:
            sums += [F.count(c).alias(f"{c}__n"), F.expr(f"sum({_SPARK_SUM[kind].format(c=c)})").cast("long").alias(f"{c}__t")]
        rows = [
            F.struct(F.lit(name).alias("name"), F.lit(c).alias("field"), F.col("n"), F.col(f"{c}__n").alias("present"),
                     F.col(f"{c}__t").alias("total")) for c, _ in fields
        ]
        parts.append(getattr(tables, name).agg(*sums).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionAll, parts)


@register("""
select o_custkey, count(*) as n, max(case when o_totalprice is null or o_orderdate is null then 1 else 0 end) = 1 as missing
from orders group by o_custkey
having count(*) > 1 or max(case when o_totalprice is null or o_orderdate is null then 1 else 0 end) = 1
""")
def unit_problems(spark, folder):
    """Units that are listed more than once or lack a value."""
    return matching.unit_problems(table(spark, folder, "orders"), "o_custkey", ["o_totalprice", "o_orderdate"])
