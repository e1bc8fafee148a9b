"""Malformed records, day texts of several forms, and folders with some tables."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from vitalspark import operators as ops
from vitalspark.__main__ import main
from vitalspark.functions import day_of_text
from vitalspark.plans.analyses import ANALYSES, Params
from vitalspark.sources import MissingTable, load_table, read_tables, reject_counts
from vitalspark.sources.schemas import DAILY_ACTIVITY

from conftest import rows

HEART = """Id,Day,Mean_Value,Entry_Count
11,2021-02-28,61.5,10
12,3/1/2021,70.0,20
13,2021-02-30,88.25,5
14,2021-03-01,high,7
15,2021-03-01,90.0,7.5
16,2021-03-01,90.0
17,2021-03-01,90.0,7,extra
,2021-03-02,,
x1,soon,fast,many
"""


@pytest.fixture
def heart(tmp_path):
    path = tmp_path / "daily_heartrate.csv"
    path.write_text(HEART)
    return str(path)


def test_every_malformed_field_is_a_reject(spark, heart):
    read = load_table(spark, "daily_heartrate", heart)
    got = {r["record"]: r["reasons"] for r in read.rejects.collect()}
    assert got == {
        "13,2021-02-30,88.25,5": ["Day: not date: 2021-02-30"],
        "14,2021-03-01,high,7": ["Mean_Value: not double: high"],
        "15,2021-03-01,90.0,7.5": ["Entry_Count: not int: 7.5"],
        "16,2021-03-01,90.0": ["not 4 fields"],
        "17,2021-03-01,90.0,7,extra": ["not 4 fields"],
        "x1,soon,fast,many": ["Id: not bigint: x1", "Day: not date: soon", "Mean_Value: not double: fast", "Entry_Count: not int: many"],
    }
    assert all(r["file"].endswith("daily_heartrate.csv") and r["table"] == "daily_heartrate" for r in read.rejects.collect())
    # an empty field is NULL and no fault; a faulty one is NULL in this mode, and listed above
    table = {r["Id"]: r for r in read.rows.collect()}
    assert len(read.rows.collect()) == 9 and table[12]["Day"] == dt.date(2021, 3, 1)
    assert table[13]["Day"] is None and table[14]["Mean_Value"] is None and table[15]["Entry_Count"] is None
    nulls = read.rows.selectExpr(*[f"count_if({c} is null) as {c}" for c in read.rows.columns]).head().asDict()
    # NULLs are empty fields, fields that are not there, or listed
    assert nulls == {"Id": 1 + 1, "Day": 2, "Mean_Value": 1 + 2, "Entry_Count": 1 + 1 + 2}
    counts = {r["kind"]: r["records"] for r in reject_counts(read.rejects).collect()}
    assert counts == {"Day": 2, "Mean_Value": 2, "Entry_Count": 2, "Id": 1, "not 4 fields": 2}


def test_records_dropped_or_failing(spark, heart):
    kept = load_table(spark, "daily_heartrate", heart, mode="DROPMALFORMED")
    assert rows(kept.rows, "Id") == rows(kept.rows.select("Id", "Entry_Count"), "Id") == [(11,), (12,), (None,)]
    assert kept.rejects.select("file").count() == 6  # whatever columns are read
    with pytest.raises(PySparkException, match="Day: not date"):
        load_table(spark, "daily_heartrate", heart, mode="FAILFAST").rows.select("Id").collect()
    with pytest.raises(ValueError):
        load_table(spark, "daily_heartrate", heart, mode="SOMETIMES")


def test_day_texts(spark):
    good = {
        "4/2/2021": (2021, 4, 2), "04/02/2021": (2021, 4, 2), "2021-04-02": (2021, 4, 2), "2021-4-2": (2021, 4, 2),
        "4/2/2021 12:00:00 AM": (2021, 4, 2), "2021-04-02T23:59:59.5Z": (2021, 4, 2), "2021-04-02 01:02:03+02:00": (2021, 4, 2),
        " 12/31/1999 ": (1999, 12, 31), "2/29/2020": (2020, 2, 29),
    }
    bad = ["", "soon", "2021-02-30", "13/1/2021", "4/2/21", "2021/04/02", "4-2-2021", "4/2/2021 later", "20210402", "2/29/2021"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", day_of_text("t", strict=False).alias("d")).collect()}
    assert got == {**{t: dt.date(*d) for t, d in good.items()}, **dict.fromkeys([*bad, None])}
    strict = df.where(df.t.isin(*good) | df.t.isNull()).select(day_of_text("t").alias("d"))
    assert strict.where("d is null").count() == 1
    for t in bad:
        with pytest.raises(PySparkException, match="not a day"):
            spark.createDataFrame([(t,)], "t string").select(day_of_text("t")).collect()


def test_the_three_day_forms_are_equal(spark):
    day = dt.date(2021, 3, 7)
    forms = {"date": day, "iso": "2021-03-07", "slashes": "3/7/2021", "iso time": "2021-03-07 00:00:00"}
    outs = []
    for value in forms.values():
        schema = T.StructType([T.StructField(f.name, T.DateType() if f.name == "ActivityDate" and value is day else f.dataType) for f in DAILY_ACTIVITY])
        row = [(1, value, 3, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1, 0, 0, 0, 9)]
        table = spark.createDataFrame(row, schema)
        for strict in (True, False):
            outs.append(rows(ops.activity_clean(table, strict=strict)))
    assert all(o == outs[0] for o in outs) and outs[0][0][:2] == (1, day)


def test_a_folder_with_one_table_serves_its_analyses(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    lines = "Id,SleepDay,TotalSleepRecords,TotalMinutesAsleep,TotalTimeInBed\n1,2021-03-07,1,100,120\n2,3/7/2021 12:00:00 AM,1,x,90\n"
    (tmp_path / "in" / "daily_sleep.csv").write_text(lines)
    t = read_tables(spark, str(tmp_path / "in"))
    assert t.names == ("daily_sleep",) and ANALYSES["sleep_clean"](t, Params()).count() == 2
    with pytest.raises(MissingTable, match="daily_activity"):
        ANALYSES["weekday_avg"](t, Params())
    out = tmp_path / "out"
    assert main(["--tables", str(tmp_path / "in"), "--out", str(out)]) == 0
    said = capsys.readouterr().err
    assert "skip weekday_avg" in said and "rejected 1 records of daily_sleep" in said and "TotalMinutesAsleep" in said
    assert {p.name for p in out.iterdir()} == {"sleep_clean", "sleep_weekday_avg", "rejects"}
    assert spark.read.parquet(str(out / "rejects")).head()["record"] == "2,3/7/2021 12:00:00 AM,1,x,90"
    with pytest.raises(FileNotFoundError):
        read_tables(spark, str(tmp_path / "out"))
