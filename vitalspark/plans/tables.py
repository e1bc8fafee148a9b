"""Queries over tables that the library writes and reads back: CSV exports with
their rejects, checked and ordered tables, stored moments.

Each takes the tracker tables, writes into the shared folder and returns a frame
over what it wrote, so its work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark import operators as ops
from vitalspark.constants import DAY_FORMAT
from vitalspark.plans.analyses import Params, activity_clean, heartrate_calories, mets_clean
from vitalspark.sources.event_log import TrackerTables
from vitalspark.sources.ordered import read_ordered, write_ordered
from vitalspark.sources.readers import load_table


def csv_rejects(t: TrackerTables, p: Params) -> DataFrame:
    """The daily sleep table as a CSV export and back: the export writes minutes
    with two decimals unless they are whole, and the declared type is an integer,
    so days with a fraction of a minute are rejects."""
    def minutes(c: str):
        return F.regexp_replace(F.col(c).cast("decimal(18,2)").cast("string"), r"\.00$", "")

    sleep = t.daily_sleep
    path = ops.scratch_path(sleep.sparkSession, "daily_sleep_csv")
    sleep.select(
        "Id", "SleepDay", "TotalSleepRecords",
        minutes("TotalMinutesAsleep").alias("TotalMinutesAsleep"), minutes("TotalTimeInBed").alias("TotalTimeInBed"),
    ).write.option("header", True).csv(path)
    read = load_table(sleep.sparkSession, "daily_sleep", path, mode="DROPMALFORMED")
    good = read.rows.select("Id", "SleepDay", "TotalMinutesAsleep", "TotalTimeInBed", F.lit(None).cast("string").alias("Reasons"))
    field = F.split("record", ",")
    none = F.lit(None).cast("int")
    bad = read.rejects.select(
        field[0].cast("long").alias("Id"), field[1].alias("SleepDay"), none.alias("TotalMinutesAsleep"),
        none.alias("TotalTimeInBed"), F.array_join("reasons", "; ").alias("Reasons"),
    )
    return good.unionByName(bad)


DAY_FORMS = {"date": None, "slashes": DAY_FORMAT, "iso": "yyyy-MM-dd", "time": "yyyy-MM-dd'T'00:00:00"}


def activity_day_forms(t: TrackerTables, p: Params) -> DataFrame:
    """The cleaned activity table from each form in which a day may come."""
    raw = t.daily_activity
    outs = []
    for name, form in DAY_FORMS.items():
        day = F.col("ActivityDate") if form is None else F.date_format("ActivityDate", form)
        clean = ops.activity_clean(raw.withColumn("ActivityDate", day), strict=p.strict)
        outs.append(clean.select(F.lit(name).alias("Form"), "Id", "Date", "TotalSteps", "WeekDayN", "SumOfDistances"))
    return reduce(DataFrame.unionByName, outs)


def moment_fits(t: TrackerTables, p: Params) -> DataFrame:
    """Calories on heart rate: one table of moments by user and day, stored, and
    from it the line of each user, of each day and of all."""
    days = heartrate_calories(t, p)
    path = ops.scratch_path(days.sparkSession, "moments")
    # any fixed point near the data serves: both axes' usual values
    ops.moment_table(days, "AvgHeartrate", "Calories", ["Id", "Day"], pivot=(75.0, 150.0)).write.parquet(path)
    table = days.sparkSession.read.parquet(path)
    levels = {"user": ["Id"], "day": ["Day"], "all": []}
    none = {"Id": F.lit(None).cast("long"), "Day": F.lit(None).cast("date")}
    outs = []
    for level, by in levels.items():
        keys = [F.col(k) if k in by else none[k].alias(k) for k in none]
        outs.append(ops.fit_moments(table, by).select(F.lit(level).alias("Level"), *keys, "Slope", "Intercept", "N"))
    return reduce(DataFrame.unionByName, outs)


def load_checks(t: TrackerTables, p: Params) -> DataFrame:
    """Rows, NULLs and repeated rows of the minute table, counted while it is
    written with one row per distinct row and its copies."""
    mets = mets_clean(t, p)
    checked = ops.write_checked(mets, ops.scratch_path(mets.sparkSession, "minute_mets"), copies="Copies")
    return checked.summary(mets.sparkSession)


def activity_positions(t: TrackerTables, p: Params) -> DataFrame:
    """The cleaned activity table in its presentation order, written in several
    files and reread with each row's place in that order."""
    clean = activity_clean(t, p).select("Id", "Date", "TotalSteps")
    path = ops.scratch_path(clean.sparkSession, "activity_ordered")
    write_ordered(clean, path, ["Date", "Id"])
    return read_ordered(clean.sparkSession, path)


TABLE_QUERIES: dict[str, Callable[[TrackerTables, Params], DataFrame]] = {
    "csv_rejects": csv_rejects,
    "activity_day_forms": activity_day_forms,
    "moment_fits": moment_fits,
    "load_checks": load_checks,
    "activity_positions": activity_positions,
}
