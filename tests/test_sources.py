import datetime as dt
import os
import tempfile

import pytest

from vitalspark import operators as ops
from vitalspark.plans.analyses import ANALYSES, NEEDS_EVENTS, Params, present
from vitalspark.sources import TrackerTables, load_tracker_tables, read_table

from conftest import SF_SMALL

# Hand-made rows in the trackers' CSV layout, one case a row: a NULL distance, an
# all-zero day, days with activity or sleep only, two users asleep on one date, an
# exact duplicate, a heart rate without activity, noon and past-noon hours.
EXPORTS = {
    "daily_activity": (
        "Id,ActivityDate,TotalSteps,TotalDistance,VeryActiveDistance,ModeratelyActiveDistance,LightActiveDistance,"
        "SedentaryActiveDistance,VeryActiveMinutes,FairlyActiveMinutes,LightlyActiveMinutes,SedentaryMinutes,Calories",
        [
            "11,2/28/2021,600,1.5,0.25,0.5,0.75,0,5,5,20,900,1500",
            "11,3/1/2021,900,2.0,,0.5,1.5,0,5,5,30,900,1600",
            "12,2/28/2021,0,0,0,0,0,0,0,0,0,1440,1100",
            "12,3/1/2021,300,0.5,0,0,0.5,0,0,0,15,1000,1150",
            "13,2/27/2021,750,1.0,0,1.0,0,0,0,12,0,1000,1300",
            "14,3/1/2021,420,0.75,0.75,0,0,0,9,0,0,1000,1250",
        ],
        "\r\n",
    ),
    "daily_sleep": (
        "Id,SleepDay,TotalSleepRecords,TotalMinutesAsleep,TotalTimeInBed",
        [
            "11,2/28/2021 12:00:00 AM,1,100,120",
            "11,2/28/2021 12:00:00 AM,1,100,120",
            "12,2/28/2021 12:00:00 AM,1,200,230",
            "12,3/1/2021 12:00:00 AM,3,90,95",
            "15,3/2/2021 12:00:00 AM,1,50,60",
        ],
        "\r\n",
    ),
    "daily_heartrate": (
        "Id,Day,Mean_Value,Entry_Count",
        ["11,2021-02-28,61.5,10", "12,2021-03-01,70.0,20", "14,2021-03-01,88.25,5", "16,2021-03-01,90.0,7"],
        "\n",
    ),
    "minute_mets": (
        "Id,Activity,Minute,METs",
        ["11,2/28/2021,23:58,10", "11,2/28/2021,23:59,16", "12,3/1/2021,00:00,17"],
        "\n",
    ),
    "hourly_steps": (
        "Id,ActivityHour,StepTotal",
        ["11,2/28/2021 12:00:00 AM,3", "11,2/28/2021 12:00:00 PM,40", "12,3/1/2021 1:05:00 PM,25"],
        "\n",
    ),
    "hourly_calories": (
        "Id,ActivityHour,Calories",
        ["11,2/28/2021 12:00:00 AM,50", "12,3/1/2021 1:05:00 PM,65"],
        "\n",
    ),
    "daily_intensities": (
        "Id,ActivityDay,SedentaryMinutes,LightlyActiveMinutes,FairlyActiveMinutes,VeryActiveMinutes,"
        "SedentaryActiveDistance,LightActiveDistance,ModeratelyActiveDistance,VeryActiveDistance",
        ["13,2/27/2021,1000,0,12,0,0,0,1.0,0"],
        "\r\n",
    ),
    "daily_calories": ("Id,ActivityDay,Calories", ["13,2/27/2021,1300"], "\r\n"),
    "daily_steps": ("Id,ActivityDay,StepTotal", ["13,2/27/2021,750"], "\r\n"),
}


@pytest.fixture(scope="module")
def csv_tables(spark):
    folder = tempfile.mkdtemp(prefix="vitalspark-csv-")
    tables = {}
    for name, (header, lines, eol) in EXPORTS.items():
        path = os.path.join(folder, f"{name}.csv")
        with open(path, "w", newline="") as fh:
            fh.write(eol.join([header, *lines]) + eol)
        tables[name] = read_table(spark, name, path)
    return TrackerTables(**tables)


def test_csv_read_with_declared_schema(csv_tables):
    a = csv_tables.daily_activity
    assert dict(a.dtypes)["Id"] == "bigint" and dict(a.dtypes)["ActivityDate"] == "string"
    assert a.count() == 6
    assert dict(csv_tables.daily_heartrate.dtypes)["Day"] == "date"


def test_read_table_rejects_unknown_and_missing(spark):
    with pytest.raises(KeyError):
        read_table(spark, "nope", "/tmp/x.csv")
    folder = tempfile.mkdtemp(prefix="vitalspark-pq-")
    spark.createDataFrame([(1,)], "Id long").write.parquet(os.path.join(folder, "t"))
    with pytest.raises(ValueError):
        read_table(spark, "daily_sleep", os.path.join(folder, "t"), fmt="parquet")


def test_every_analysis_runs_on_csv_exports(spark, csv_tables):
    p = Params()
    for key, fn in ANALYSES.items():
        if key in NEEDS_EVENTS:
            with pytest.raises(ValueError):
                fn(csv_tables, p)
            continue
        present(key, fn(csv_tables, p)).collect()


def test_csv_pipeline_values(csv_tables):
    p = Params()
    act = ANALYSES["activity_clean"](csv_tables, p)
    # the all-zero day and the day with a NULL distance are dropped
    assert act.count() == 4
    sleep = ANALYSES["sleep_clean"](csv_tables, p)
    assert sleep.count() == 5  # the exact duplicate is kept
    svc = {r.Id: r for r in ANALYSES["sleep_vs_calories"](csv_tables, p).collect()}
    assert svc[11].TotalMinutesAsleep == 100 + 100
    assert svc[11].Calories == 1500 + 1500
    hc = ANALYSES["heartrate_calories"](csv_tables, p).collect()
    assert sorted((r.Id, r.Day) for r in hc) == [
        (11, dt.date(2021, 2, 28)),
        (12, dt.date(2021, 3, 1)),
        (14, dt.date(2021, 3, 1)),
    ]
    assert ops.distinct_users(csv_tables.daily_activity).count() == 4


def test_event_log_tables(spark):
    t = load_tracker_tables(spark, SF_SMALL)
    ev = t.events
    n_view = ev.where("event_type = 'view'").count()
    assert t.daily_sleep.agg({"TotalSleepRecords": "sum"}).collect()[0][0] == n_view
    assert t.minute_mets.count() == ev.count()
    assert t.hourly_steps.agg({"StepTotal": "sum"}).collect()[0][0] == ev.count()
    assert t.daily_activity.agg({"TotalSteps": "sum"}).collect()[0][0] == ev.count() - n_view


def test_present_applies_the_original_order(csv_tables):
    out = present("activity_clean", ANALYSES["activity_clean"](csv_tables, Params())).collect()
    keys = [(r.Date, r.Id) for r in out]
    assert keys == sorted(keys)


def test_every_analysis_on_an_empty_event_log(spark):
    from vitalspark.sources import tracker_tables

    empty = load_tracker_tables(spark, SF_SMALL).events.where("false")
    t = tracker_tables(empty)
    p = Params()
    for key, fn in ANALYSES.items():
        out = fn(t, p).collect()
        # global aggregates still return their single row; everything else is empty
        assert len(out) <= 1, key


def test_shared_rollup_equals_separate_tables(spark):
    from vitalspark.sources import tracker_tables
    from vitalspark.sources.event_log import read_events

    from conftest import rows

    events = read_events(spark, SF_SMALL)
    # add rows with NULL kind / value / user to check the CASE-filtered measures
    extra = spark.createDataFrame(
        [(-1, dt.datetime(2024, 1, 3, 10), 3, None, 5.0, None),
         (-2, dt.datetime(2024, 1, 3, 11), 3, "click", None, None),
         (-3, dt.datetime(2024, 1, 3, 12), None, "view", 7.5, None)],
        events.schema,
    )
    ev = events.unionByName(extra)
    separate, shared = tracker_tables(ev), tracker_tables(ev, share_daily=True)
    for name in ("daily_activity", "daily_sleep", "daily_heartrate", "daily_intensities"):
        a, b = getattr(separate, name), getattr(shared, name)
        assert a.columns == b.columns, name
        assert a.dtypes == b.dtypes, name
        assert rows(a) == rows(b), name


def test_bucketed_rollup_joins_without_shuffle(spark):
    from vitalspark import operators as ops
    from vitalspark.sources import tracker_tables
    from vitalspark.sources.event_log import read_events

    from conftest import rows

    ev = read_events(spark, SF_SMALL)
    bucketed = tracker_tables(ev, rollup_table="vitalspark_test_rollup")
    shared = tracker_tables(ev, share_daily=True)
    hc = ops.heartrate_calories(bucketed.daily_activity, bucketed.daily_heartrate)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:  # as for tables too large to broadcast
            spark.conf.set(k, "-1")
        plan = hc._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan
    assert rows(hc) == rows(ops.heartrate_calories(shared.daily_activity, shared.daily_heartrate))


def test_lenient_analyses_on_dirty_exports(spark):
    from pyspark.errors import PySparkException

    folder = tempfile.mkdtemp(prefix="vitalspark-dirty-")
    dirty = dict(EXPORTS)
    header, lines, eol = EXPORTS["daily_sleep"]
    dirty["daily_sleep"] = (header, [*lines, "13,not a date,1,30,40"], eol)
    header, lines, eol = EXPORTS["hourly_steps"]
    dirty["hourly_steps"] = (header, [*lines, "13,13/45/2021 99:00:00 XM,5"], eol)
    for name, (h, ls, e) in dirty.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", newline="") as fh:
            fh.write(e.join([h, *ls]) + e)
    from vitalspark.sources import read_tables

    t = read_tables(spark, folder)
    with pytest.raises(PySparkException):
        ANALYSES["sleep_clean"](t, Params()).collect()
    lenient = Params(strict=False)
    sleep = ANALYSES["sleep_clean"](t, lenient).collect()
    assert len(sleep) == 6 and sum(r.Date is None for r in sleep) == 1
    hours = ANALYSES["hourly_split"](t, lenient).collect()
    assert len(hours) == 4 and sum(r.Hour is None for r in hours) == 1


def test_read_table_failfast_mode(spark):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    folder = tempfile.mkdtemp(prefix="vitalspark-failfast-")
    path = os.path.join(folder, "daily_sleep.csv")
    with open(path, "w") as fh:
        fh.write("Id,SleepDay,TotalSleepRecords,TotalMinutesAsleep,TotalTimeInBed\n1,2/28/2021 12:00:00 AM,x,3,4\n")
    assert read_table(spark, "daily_sleep", path).collect()[0]["TotalSleepRecords"] is None  # PERMISSIVE
    with pytest.raises((PySparkException, Py4JJavaError)):  # a task failure may arrive unconverted
        read_table(spark, "daily_sleep", path, mode="FAILFAST").collect()
