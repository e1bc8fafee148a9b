"""Activity x sleep x heart-rate joins.

Two of the analyses join activity and sleep on the calendar day alone: every
activity row of a day meets every sleep row of that day. The key has as many
values as there are days, and one day can hold a third of the rows.

* ``salted_join`` is the join for such keys: the rows of the large side get one
  of several salts, the small side is repeated once a salt, and a key is spread
  over that many tasks. It needs no broadcast and no measuring of sizes.
* ``user_segments`` and ``user_segments_join`` aggregate sleep per day first (one
  row a day), so their joins are linear in activity.
* ``sleep_on_activity_days`` and ``sleep_on_activity_days_join`` must return the
  fan-out rows themselves. A sleep row (in the first, one for all equal ones) gets
  its number of copies from its day; running sums of the output give each day its
  place in the whole output, which is cut into tasks of equal output volume; the
  copies are made there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.constants import (
    SEGMENT_LESS_LESS,
    SEGMENT_LESS_MORE,
    SEGMENT_MORE_LESS,
    SEGMENT_MORE_MORE,
    SEGMENT_OTHER,
    SEGMENT_SLEEP_CUT,
    SEGMENT_STEPS_CUT,
)
from vitalspark.functions.classify import quadrant
from vitalspark.functions.columns import to_day
from vitalspark.operators.clean import DISTANCE_PARTS
from vitalspark.functions.columns import sum_columns
from vitalspark.operators.sizing import materialize

MINUTE_COLUMNS = ("VeryActiveMinutes", "FairlyActiveMinutes", "LightlyActiveMinutes", "SedentaryMinutes")

#: Rows of output a task of the fan-out makes.
TASK_ROWS = 4_000_000
#: Largest number of copies that one generated array holds.
REPLICATION_CHUNK = 100_000
#: Salts for each shuffle partition: enough keys a partition that they even out.
SALTS_PER_PARTITION = 8


def default_salts(spark) -> int:
    return SALTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(large: DataFrame, small: DataFrame, on: Sequence[str], salts: int | None = None) -> DataFrame:
    """Inner join on ``on`` in which a key's rows of ``large`` are spread over
    ``salts`` tasks (by a hash of the row) and ``small`` is repeated ``salts``
    times. ``small`` is meant to have few rows a key."""
    n = salts or default_salts(large.sparkSession)
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_salt")
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns]), F.lit(n)).cast("int"))
    return dealt.join(small.select("*", each), [*on, "_salt"]).drop("_salt")


def _rows_per_day(activity: DataFrame) -> DataFrame:
    return activity.where(F.col("Date").isNotNull()).groupBy("Date").agg(F.count(F.lit(1)).alias("_n"))


def sleep_on_activity_days_join(activity: DataFrame, sleep: DataFrame, salts: int = 16) -> DataFrame:
    """Every sleep row once for each activity row of its day: the sleep rows
    themselves are joined to their day (``salts`` copies of the days) with its number
    of activity rows, and each is copied that often."""
    met = salted_join(sleep.select("Date", "Id", "TotalMinutesAsleep"), _rows_per_day(activity), ["Date"], salts)
    return _copied(met.select("Date", "TotalMinutesAsleep", F.col("_n").alias("_copies")))


def sleep_on_activity_days(
    activity: DataFrame,
    sleep: DataFrame,
    chunk: int = REPLICATION_CHUNK,
    task_rows: int = TASK_ROWS,
    salts: int | None = None,
) -> DataFrame:
    """Same multiset of rows as :func:`sleep_on_activity_days_join`.

    Both sides are first reduced by aggregation: activity to its number of rows a
    day, sleep to its distinct (day, minutes) with their number. Their product is
    the number of copies of each distinct row.
    """
    distinct = sleep.groupBy("Date", "TotalMinutesAsleep").agg(F.count(F.lit(1)).alias("_k"))
    met = salted_join(distinct, _rows_per_day(activity), ["Date"], salts)
    return _copied(met.select("Date", "TotalMinutesAsleep", (F.col("_n") * F.col("_k")).alias("_copies")), chunk, task_rows, salts)


def _copied(parts: DataFrame, chunk: int = REPLICATION_CHUNK, task_rows: int = TASK_ROWS, salts: int | None = None) -> DataFrame:
    """Each row of ``parts`` (Date, TotalMinutesAsleep, _copies) as often as ``_copies``.

    Copies beyond ``chunk`` are cut into several rows. A day's output begins where
    that of the days before it ends (a running sum over one row a day), the line of
    all output is cut every ``task_rows`` rows, and each row goes to a task within
    its day's stretch, equal rows to several. So the number of tasks follows the
    output, and one day may take many.
    """
    parts = materialize(parts)  # read for the running sums and for the copies
    line = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_day = materialize(  # one row a day
        parts.groupBy("Date").agg(F.sum("_copies").alias("_rows")).withColumn("_end", F.sum("_rows").over(line))
    )
    total = per_day.agg(F.max("_end")).head()[0] or 0
    stretch = per_day.select(
        "Date",
        F.floor((F.col("_end") - F.col("_rows")) / task_rows).alias("_first"),
        F.floor((F.col("_end") - 1) / task_rows).alias("_last"),
    )
    cut = parts.select(
        "Date",
        "TotalMinutesAsleep",
        "_copies",
        F.monotonically_increasing_id().alias("_row"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / chunk))).alias("_c"),
    ).withColumn("_copies", F.least(F.lit(chunk).cast("long"), F.col("_copies") - F.col("_c") * chunk))
    placed = salted_join(cut, stretch, ["Date"], salts)
    width = F.col("_last") - F.col("_first") + 1
    task = F.col("_first") + F.pmod(F.xxhash64("Date", "TotalMinutesAsleep", "_row", "_c"), width)
    tasks = max(1, -(-total // task_rows))
    dealt = placed.select("Date", "TotalMinutesAsleep", "_copies", task.cast("int").alias("_task")).repartitionById(tasks, "_task")
    return dealt.select(
        "Date", "TotalMinutesAsleep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_k")
    ).drop("_k")


def _segment(df: DataFrame, steps_cut: float, sleep_cut: float) -> DataFrame:
    return df.withColumn(
        "UserSegment",
        quadrant(
            "AvgSteps",
            steps_cut,
            "AvgMinutesAsleep",
            sleep_cut,
            SEGMENT_MORE_MORE,
            SEGMENT_MORE_LESS,
            SEGMENT_LESS_MORE,
            SEGMENT_LESS_LESS,
            SEGMENT_OTHER,
        ),
    ).select("Id", "AvgSteps", "AvgMinutesAsleep", "UserSegment")


def user_segments_join(
    activity: DataFrame,
    sleep: DataFrame,
    steps_cut: float = SEGMENT_STEPS_CUT,
    sleep_cut: float = SEGMENT_SLEEP_CUT,
    on: Sequence[str] = ("Date",),
    salts: int = 16,
) -> DataFrame:
    """Per user the averages of ``TotalSteps`` and ``TotalMinutesAsleep`` over the
    rows of the join on ``on``, and the segment. What the averages need of the sleep
    rows of a key (their number, sum and non-NULL count) is summed before the join,
    so each activity row meets one row however many sleep rows its key has. On the
    day alone the join is :func:`salted_join` with ``salts`` copies of the days."""
    keys = list(on)
    left = activity.select(*dict.fromkeys(["Id", *keys, "TotalSteps"]))
    right = sleep.select(*dict.fromkeys([*keys, "TotalMinutesAsleep"]))
    # the types that averages over the joined rows have
    steps_type = left.agg(F.avg("TotalSteps")).schema[0].dataType
    sleep_type = right.agg(F.avg("TotalMinutesAsleep")).schema[0].dataType
    asleep = F.col("TotalMinutesAsleep")
    met = (
        right.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(asleep).alias("_m"), F.count(asleep).alias("_nm"))
    )
    joined = salted_join(left, met, keys, salts) if keys == ["Date"] else left.join(met, keys)
    steps, times = F.col("TotalSteps"), F.col("_n")
    per_user = joined.groupBy("Id").agg(
        F.try_divide(F.sum(steps * times), F.sum(F.when(steps.isNotNull(), times))).cast(steps_type).alias("AvgSteps"),
        F.try_divide(F.sum("_m"), F.sum("_nm")).cast(sleep_type).alias("AvgMinutesAsleep"),
    )
    return _segment(per_user, steps_cut, sleep_cut)


def user_segments(
    activity: DataFrame,
    sleep: DataFrame,
    steps_cut: float = SEGMENT_STEPS_CUT,
    sleep_cut: float = SEGMENT_SLEEP_CUT,
    on: Sequence[str] = ("Date",),
    salts: int | None = None,
) -> DataFrame:
    """Per user ``AvgSteps``, ``AvgMinutesAsleep`` and a 2 x 2 segment, with
    the same values as :func:`user_segments_join`.

    For the day-only join (the default, as the analysis defines it) sleep is
    pre-aggregated per day: ``n`` rows, ``m`` = sum of minutes asleep, ``nm`` =
    non-NULL count. An activity row on day d stands for ``n(d)`` joined rows,
    so AvgSteps = sum(steps * n) / sum(n | steps not NULL) and
    AvgMinutesAsleep = sum(m) / sum(nm). The per-day rows are repeated per salt,
    so a day with a third of the activity is spread over tasks without a
    broadcast. Joining on (Id, Date) has no fan-out and runs as the plain join.
    """
    if tuple(on) != ("Date",):
        return user_segments_join(activity, sleep, steps_cut, sleep_cut, on)
    per_day = (
        sleep.where(F.col("Date").isNotNull())
        .groupBy("Date")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("TotalMinutesAsleep").alias("_m"),
            F.count("TotalMinutesAsleep").alias("_nm"),
        )
    )
    steps = F.col("TotalSteps")
    per_user = (
        salted_join(activity.select("Id", "Date", "TotalSteps"), per_day, ["Date"], salts)
        .groupBy("Id")
        .agg(
            F.try_divide(
                F.sum(steps * F.col("_n")), F.sum(F.when(steps.isNotNull(), F.col("_n")))
            ).alias("AvgSteps"),
            F.try_divide(F.sum("_m"), F.sum("_nm")).alias("AvgMinutesAsleep"),
        )
    )
    return _segment(per_user, steps_cut, sleep_cut)


def _sleep_calories(days: DataFrame) -> DataFrame:
    return days.groupBy("Id").agg(
        F.sum("TotalMinutesAsleep").alias("TotalMinutesAsleep"),
        F.sum("TotalTimeInBed").alias("TotalTimeInBed"),
        F.sum("Calories").alias("Calories"),
    )


def sleep_vs_calories(activity: DataFrame, sleep: DataFrame) -> DataFrame:
    """Join on (Id, Date); per user total minutes asleep, time in bed and
    calories over the days that have both records."""
    return _sleep_calories(
        activity.select("Id", "Date", "Calories")
        .join(sleep.select("Id", "Date", "TotalMinutesAsleep", "TotalTimeInBed"), ["Id", "Date"], "inner")
    )


def sleep_vs_calories_of_days(days: DataFrame, min_distance: float = 0.0) -> DataFrame:
    """The same from one frame of both tables' user-days (``TrackerTables.days``),
    with the cleaning's distance filter."""
    return _sleep_calories(days.where(sum_columns(*DISTANCE_PARTS) > F.lit(min_distance)))


def _activity_day(daily_activity: DataFrame, date_format: str | None, strict: bool):
    return to_day("ActivityDate", date_format, strict, daily_activity.schema["ActivityDate"].dataType)


def heartrate_calories(
    daily_activity: DataFrame,
    daily_heartrate: DataFrame,
    date_format: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Raw daily activity (zero-distance days included) joined with daily
    heart rate on (Id, day): ``Id, Day, Calories, AvgHeartrate``."""
    a = daily_activity.select("Id", _activity_day(daily_activity, date_format, strict).alias("Day"), "Calories")
    h = daily_heartrate.select(
        "Id",
        to_day("Day", None, strict, daily_heartrate.schema["Day"].dataType).alias("Day"),
        F.col("Mean_Value").alias("AvgHeartrate"),
    )
    return a.join(h, ["Id", "Day"], "inner").select("Id", "Day", "Calories", "AvgHeartrate")


def heartrate_calories_of_days(days: DataFrame) -> DataFrame:
    """The same from one frame of both tables' user-days (``TrackerTables.days``)."""
    return days.select("Id", "Day", "Calories", F.col("Mean_Value").alias("AvgHeartrate"))


def drilldown(
    days: DataFrame,
    daily_activity: DataFrame,
    date_format: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Join selected (Id, Day) rows back to raw daily activity and show the
    minutes spent at each intensity next to the calories of the day."""
    a = daily_activity.select("Id", _activity_day(daily_activity, date_format, strict).alias("Day"), *MINUTE_COLUMNS)
    return a.join(days.select("Id", "Day", "Calories"), ["Id", "Day"], "inner").select("Id", "Day", *MINUTE_COLUMNS, "Calories")
