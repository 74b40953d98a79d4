import datetime as dt
import glob
import gzip
import os

import pytest

from anchorline import session
from anchorline.operators.cohort import cohort_from_list
from anchorline.sources import extracts, sinks


def write(path, text):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as out:
        out.write(text)


def test_extract_by_prefix(spark, tmp_path):
    write(tmp_path / "labs_1.csv", "fin,Result Value\n007,<5\n")
    write(tmp_path / "labs_2.csv.gz", "fin,Result Value\n008,7\n")
    write(tmp_path / "vitals.csv", "fin,Result Value\n009,1\n")
    df = extracts.read_extract(spark, str(tmp_path), "labs", "fin string, `Result Value` string")
    assert sorted(tuple(r) for r in df.collect()) == [("007", "<5"), ("008", "7")]


def test_extract_with_another_header_fails(spark, tmp_path):
    write(tmp_path / "labs_1.csv", "result,fin\n5,007\n")
    with pytest.raises(Exception, match="(?i)header"):
        extracts.read_extract(spark, str(tmp_path), "labs", "fin string, result string").collect()


def test_extract_in_subfolders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    write(tmp_path / "a" / "id_1.csv", "fin\n1\n")
    assert extracts.read_extract(spark, str(tmp_path), "id", "fin string", recursive=True).count() == 1


def test_typed_csv(spark, tmp_path):
    write(tmp_path / "list.csv", "fin,date,time\n007,3/9/2024,05:06:07\n008,not a date,01:00:00\n")
    df = extracts.read_typed_csv(spark, str(tmp_path / "list.csv"), "fin string, date date, time string")
    rows = {r.fin: (r.date, r._corrupt_record) for r in df.collect()}
    assert rows["007"] == (dt.date(2024, 3, 9), None)
    assert rows["008"][0] is None and rows["008"][1].startswith("008")
    with pytest.raises(Exception, match="does not fit"):
        extracts.require_clean(df).collect()
    write(tmp_path / "good.csv", "fin,date,time\n007,3/9/2024,05:06:07\n")
    good = extracts.read_typed_csv(spark, str(tmp_path / "good.csv"), "fin string, date date, time string")
    assert extracts.require_clean(good).columns == ["fin", "date", "time"]
    assert extracts.require_clean(good).count() == 1


def test_positional_names(spark, tmp_path):
    write(tmp_path / "p.csv", "Some Header,Other\n1,0042\n")
    df = extracts.read_positional(spark, str(tmp_path / "p.csv"), "id long, fin string")
    assert [tuple(r) for r in df.collect()] == [(1, "0042")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("sbp", "1", 90.0), ("hr", "1", 70.0), ("hr", "2", None)], "event_group string, fin string, x double")
    sinks.write_groups(df, str(tmp_path / "groups"))
    assert glob.glob(str(tmp_path / "groups" / "event_group=hr" / "*.csv.gz"))
    back = spark.read.option("header", True).schema("fin string, x double, event_group string").csv(str(tmp_path / "groups"))
    assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == sorted(tuple(r) for r in df.collect())
    written = sinks.write_datasets({"a": df, "b": df.limit(1)}, str(tmp_path / "sets"))
    assert spark.read.parquet(written["a"]).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_datasets({"a": df}, str(tmp_path / "sets"))
    sinks.write_datasets({"a": df}, str(tmp_path / "csv"), fmt="csv")
    assert glob.glob(str(tmp_path / "csv" / "a" / "*.csv"))


def test_cohort_list(spark):
    assert sorted(r.alias for r in cohort_from_list(spark, ["007", "007", "8"]).collect()) == ["007", "8"]


def test_scratch_tables_go_with_their_block(spark):
    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with session.scratch(spark):
        kept = session.stable(spark.range(5))
        assert kept.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before
    session.stable(spark.range(5))
    assert len(set(os.listdir(folder)) - before) == 1
