"""Run every registered query beside its SQL and compare rows. Usage: oracle.py FOLDER [name ...]"""

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder):
    import duckdb

    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return "" if value is None else str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records), [names[i] for i in order]


def compare(spark, db, query, sql, folder):
    """(problem or None, row count)"""
    df = query(spark, folder)
    got, got_names = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (None if got else "no rows"), len(got)
    cursor = db.execute(sql)
    want, want_names = rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)}; extra {extra}; missing {lost}", len(got)
    return (None if got else "no rows"), len(got)


def main(folder, names):
    import __spark_entry__ as entry
    from anchorline.session import build_session

    spark = build_session(
        "oracle", master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__driver__host="127.0.0.1", spark__driver__bindAddress="127.0.0.1",
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, queries, sql = duck(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            problem, n = compare(spark, db, queries[name], sql.get(name), folder)
        except Exception as error:  # report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {n:7d} rows {time.time() - start:5.1f}s "
              f"{'' if name in sql else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(names or queries)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
