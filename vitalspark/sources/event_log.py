"""Derive the nine tracker tables from a raw event log.

An event log row is ``(user, ts, kind, value)``. Each tracker table is one
aggregation of it (per user-day, per user-hour) or a projection (per event),
declared with the DataFrame API so Catalyst prunes the log to the columns a
query needs, pushes the ``kind`` filter into the Parquet scan and aggregates
map-side before the shuffle on (user, day).

When an analysis combines several daily tables, :func:`daily_rollup` computes
all of them in one aggregation over one scan (``tracker_tables(share_daily=
True)`` checkpoints it, or writes it bucketed with ``rollup_table=``), and the
tables are projections of it.

The mapping of event kinds to tracker measures is a parameter
(:class:`EventMapping`); its defaults describe the driver's ``events`` table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspark.constants import DAY_FORMAT
from vitalspark.sources.schemas import EVENTS


@dataclass(frozen=True)
class EventMapping:
    user: str = "user_id"
    ts: str = "ts"
    kind: str = "event_type"
    value: str = "value"
    sleep_kind: str = "view"  # one sleep record per event of this kind
    heart_kind: str = "click"  # heart-rate samples
    very_kind: str = "purchase"
    moderate_kind: str = "signup"
    light_kind: str = "click"
    sedentary_kind: str = "error"
    calories_per_value: float = 2.0
    bed_minutes_per_record: int = 10
    mets_divisor: float = 4.0


TABLE_NAMES = (
    "daily_activity",
    "daily_calories",
    "daily_heartrate",
    "daily_intensities",
    "daily_steps",
    "daily_sleep",
    "minute_mets",
    "hourly_steps",
    "hourly_calories",
)


class MissingTable(LookupError):
    """An analysis asked for a table that was not given."""


class TrackerTables:
    """The nine logical inputs of the analyses, or those of them that there are.

    Each table is given as a DataFrame or as a zero-argument function that
    builds one; functions run on first access, so a query constructs (and
    has analysed) only the tables it reads. A table that was not given raises
    :class:`MissingTable` when it is asked for, so a folder with one export
    serves the analyses of that export. ``events`` is the raw log, when
    the tables came from one. ``days`` builds one frame of several daily tables'
    measures, per user-day found in all of them, where the source can do that
    without a join (see :func:`user_days`). ``rejects`` are the malformed records
    of text sources.
    """

    def __init__(
        self,
        events: DataFrame | None = None,
        days: Callable[[Mapping[str, Sequence[str]]], DataFrame] | None = None,
        rejects: DataFrame | None = None,
        **tables,
    ):
        unknown = set(tables) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        self.events = events
        self.days = days
        self.rejects = rejects
        self._sources = tables

    @property
    def names(self) -> tuple[str, ...]:
        """The tables that there are."""
        return tuple(n for n in TABLE_NAMES if n in self._sources)

    def __getattr__(self, name: str) -> DataFrame:
        sources = self.__dict__.get("_sources", {})
        if name in TABLE_NAMES and name not in sources:
            raise MissingTable(f"needs the table {name}; given: {list(sources)}")
        if name not in sources:
            raise AttributeError(name)
        value = sources[name]
        df = value if isinstance(value, DataFrame) else value()
        self.__dict__[name] = df  # later lookups bypass __getattr__
        return df


def _day(m: EventMapping):
    return F.to_date(F.col(m.ts))


def _rows(rows: Column | None) -> Column:
    return F.count(F.lit(1)) if rows is None else rows


def activity_measures(m: EventMapping = EventMapping(), rows: Column | None = None) -> list:
    """Aggregate expressions of the daily activity table (batch, streaming and
    the shared roll-up). ``rows`` counts the table's events (default: all rows
    of the group)."""
    kind, value = F.col(m.kind), F.col(m.value)

    def dist(k: str):
        return F.coalesce(F.sum(F.when(kind == k, value)), F.lit(0.0))

    def minutes(k: str):
        return F.count(F.when(kind == k, F.lit(1))).cast("int")

    return [
        _rows(rows).cast("int").alias("TotalSteps"),
        F.sum(value).alias("TotalDistance"),
        dist(m.very_kind).alias("VeryActiveDistance"),
        dist(m.moderate_kind).alias("ModeratelyActiveDistance"),
        dist(m.light_kind).alias("LightActiveDistance"),
        dist(m.sedentary_kind).alias("SedentaryActiveDistance"),
        minutes(m.very_kind).alias("VeryActiveMinutes"),
        minutes(m.moderate_kind).alias("FairlyActiveMinutes"),
        minutes(m.light_kind).alias("LightlyActiveMinutes"),
        minutes(m.sedentary_kind).alias("SedentaryMinutes"),
        (F.sum(value) * F.lit(m.calories_per_value)).alias("Calories"),
    ]


def sleep_measures(m: EventMapping = EventMapping(), rows: Column | None = None) -> list:
    value = F.col(m.value)
    return [
        _rows(rows).cast("int").alias("TotalSleepRecords"),
        F.sum(value).alias("TotalMinutesAsleep"),
        (F.sum(value) + F.lit(m.bed_minutes_per_record) * _rows(rows)).alias("TotalTimeInBed"),
    ]


def heartrate_measures(m: EventMapping = EventMapping(), rows: Column | None = None) -> list:
    return [F.avg(m.value).alias("Mean_Value"), _rows(rows).cast("int").alias("Entry_Count")]


def activity_events(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    return events.where(F.col(m.kind) != m.sleep_kind)


def sleep_events(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    return events.where(F.col(m.kind) == m.sleep_kind)


def heartrate_events(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    return events.where(F.col(m.kind) == m.heart_kind)


def sleep_day_text(day) -> Column:
    """``SleepDay`` as the exports write it: ``M/d/yyyy 12:00:00 AM``."""
    return F.concat(F.date_format(day, DAY_FORMAT), F.lit(" 12:00:00 AM"))


def daily_activity(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    """Per user-day activity from every event that is not a sleep record."""
    return (
        activity_events(events, m)
        .groupBy(F.col(m.user).alias("Id"), _day(m).alias("ActivityDate"))
        .agg(*activity_measures(m))
    )


def daily_sleep(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    """Per user-day sleep; ``SleepDay`` is written as the exports write it
    (``M/d/yyyy 12:00:00 AM``) so the cleaning step has real text to parse."""
    return (
        sleep_events(events, m)
        .groupBy(F.col(m.user).alias("Id"), _day(m).alias("_day"))
        .agg(*sleep_measures(m))
        .select("Id", sleep_day_text("_day").alias("SleepDay"), "TotalSleepRecords", "TotalMinutesAsleep", "TotalTimeInBed")
    )


def daily_heartrate(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    return (
        heartrate_events(events, m)
        .groupBy(F.col(m.user).alias("Id"), _day(m).alias("Day"))
        .agg(*heartrate_measures(m))
    )


def minute_mets(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    """One METs reading per event (the finest-grained table)."""
    return events.select(
        F.col(m.user).alias("Id"),
        _day(m).alias("Activity"),
        F.date_format(F.col(m.ts), "HH:mm").alias("Minute"),
        F.floor(F.col(m.value) / F.lit(m.mets_divisor)).cast("int").alias("METs"),
    )


def _hourly(events: DataFrame, m: EventMapping) -> DataFrame:
    # Grouped on integer (day, hour) of the wall clock; the hour stamp text is
    # formatted once per group, not once per event, and no step depends on
    # the session time zone.
    ts = F.col(m.ts)
    per_hour = events.groupBy(
        F.col(m.user).alias("Id"), F.to_date(ts).alias("_d"), F.hour(ts).alias("_h")
    ).agg(
        F.count(F.lit(1)).cast("int").alias("StepTotal"),
        F.sum(m.value).alias("Calories"),
    )
    stamp = F.make_timestamp_ntz(
        F.year("_d"), F.month("_d"), F.dayofmonth("_d"), F.col("_h"), F.lit(0), F.lit(0)
    )
    return per_hour.select(
        "Id", F.date_format(stamp, "M/d/yyyy h:mm:ss a").alias("ActivityHour"), "StepTotal", "Calories"
    )


def hourly_steps(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    return _hourly(events, m).select("Id", "ActivityHour", "StepTotal")


def hourly_calories(events: DataFrame, m: EventMapping = EventMapping()) -> DataFrame:
    return _hourly(events, m).select("Id", "ActivityHour", "Calories")


def _day_text(c: str):
    return F.date_format(F.col(c), DAY_FORMAT)


def daily_intensities(activity: DataFrame) -> DataFrame:
    return activity.select(
        "Id",
        _day_text("ActivityDate").alias("ActivityDay"),
        "SedentaryMinutes",
        "LightlyActiveMinutes",
        "FairlyActiveMinutes",
        "VeryActiveMinutes",
        "SedentaryActiveDistance",
        "LightActiveDistance",
        "ModeratelyActiveDistance",
        "VeryActiveDistance",
    )


def daily_calories(activity: DataFrame) -> DataFrame:
    return activity.select("Id", _day_text("ActivityDate").alias("ActivityDay"), "Calories")


def daily_steps(activity: DataFrame) -> DataFrame:
    return activity.select(
        "Id", _day_text("ActivityDate").alias("ActivityDay"), F.col("TotalSteps").alias("StepTotal")
    )


# --- one scan for several daily tables -------------------------------------------

ACTIVITY_COLUMNS = [
    "TotalSteps", "TotalDistance", "VeryActiveDistance", "ModeratelyActiveDistance",
    "LightActiveDistance", "SedentaryActiveDistance", "VeryActiveMinutes", "FairlyActiveMinutes",
    "LightlyActiveMinutes", "SedentaryMinutes", "Calories",
]
SLEEP_COLUMNS = ["TotalSleepRecords", "TotalMinutesAsleep", "TotalTimeInBed"]
HEART_COLUMNS = ["Mean_Value", "Entry_Count"]

#: The measures of each daily table, in the order in which they are built.
PARTS: dict[str, list[str]] = {"activity": ACTIVITY_COLUMNS, "sleep": SLEEP_COLUMNS, "heart": HEART_COLUMNS}

#: Measures by part; a part without measures is only counted.
Measures = Mapping[str, Sequence[str]]


def _checked(measures: Measures | None) -> Measures:
    if measures is None:
        return PARTS
    unknown = [f"{p}.{c}" for p, cols in measures.items() for c in cols if c not in PARTS.get(p, ())]
    if unknown or set(measures) - set(PARTS):
        raise ValueError(f"unknown parts or measures: {unknown or sorted(set(measures) - set(PARTS))}")
    return measures


def daily_rollup(
    events: DataFrame,
    m: EventMapping = EventMapping(),
    extra_keys: tuple = (),
    carry: tuple = (),
    measures: Measures | None = None,
) -> DataFrame:
    """Activity, sleep and heart-rate measures of every user-day in a single
    aggregation, plus how many events of each part the day has. Each part's
    measures read CASE-filtered copies of ``kind``/``value`` that are NULL
    outside the part, so the values equal the three separate tables while the
    log is scanned once instead of once per table. With ``measures`` only those
    parts and measures are computed (default: all)."""
    kind = F.col(m.kind)
    measures = _checked(measures)
    conds = {
        "activity": kind != m.sleep_kind,
        "sleep": kind == m.sleep_kind,
        "heart": kind == m.heart_kind,
    }
    conds = {part: cond for part, cond in conds.items() if part in measures}
    restricted = events.select(
        F.col(m.user).alias("_user"),
        _day(m).alias("_day"),
        *[F.when(c, kind).alias(f"_k_{p}") for p, c in conds.items()],
        *[F.when(c, F.col(m.value)).alias(f"_v_{p}") for p, c in conds.items()],
        *carry,  # e.g. the event-time column a streaming window needs
    )
    aggs = []
    for part, fn in (("activity", activity_measures), ("sleep", sleep_measures), ("heart", heartrate_measures)):
        if part not in measures:
            continue
        sub = replace(m, user="_user", kind=f"_k_{part}", value=f"_v_{part}")
        rows = F.count(f"_k_{part}")  # the part's events: its kind copy is non-NULL there
        aggs.append(rows.alias(f"_n_{part}"))
        aggs += [c for name, c in zip(PARTS[part], fn(sub, rows), strict=True) if name in measures[part]]
    return restricted.groupBy("_user", "_day", *extra_keys).agg(*aggs)


def user_days(events: DataFrame, measures: Measures, m: EventMapping = EventMapping()) -> DataFrame:
    """``Id, Day`` and the given measures of every user-day that has events of
    all the given parts: what a join of those daily tables on (Id, day) gives, in
    one scan and one aggregation that holds only these measures."""
    return days_from_rollup(daily_rollup(events, m, measures=measures), measures)


def days_from_rollup(rollup: DataFrame, measures: Measures) -> DataFrame:
    found = reduce(lambda a, b: a & b, (F.col(f"_n_{part}") > 0 for part in _checked(measures)))
    columns = [c for cols in measures.values() for c in cols]
    # a join on (Id, day) has no rows of NULL keys
    known = F.col("_user").isNotNull() & F.col("_day").isNotNull()
    return rollup.where(known & found).select(F.col("_user").alias("Id"), F.col("_day").alias("Day"), *columns)


def activity_from_rollup(rollup: DataFrame) -> DataFrame:
    return _from_rollup(rollup, "_n_activity", "ActivityDate", ACTIVITY_COLUMNS)


def sleep_from_rollup(rollup: DataFrame) -> DataFrame:
    return _from_rollup(rollup, "_n_sleep", "_d", SLEEP_COLUMNS).select(
        "Id", sleep_day_text("_d").alias("SleepDay"), *SLEEP_COLUMNS
    )


def heartrate_from_rollup(rollup: DataFrame) -> DataFrame:
    return _from_rollup(rollup, "_n_heart", "Day", HEART_COLUMNS)


def _from_rollup(rollup: DataFrame, part: str, day_name: str, columns: list) -> DataFrame:
    """A part's table. A measure that the roll-up was not asked for fails when it
    is read (columns that nothing reads are pruned), instead of being NULL."""
    held = {
        c: F.col(c) if c in rollup.columns else F.raise_error(F.lit(f"{c} is not in the roll-up")).cast("double")
        for c in columns
    }
    return rollup.where(F.col(part) > 0).select(
        F.col("_user").alias("Id"), F.col("_day").alias(day_name), *[c.alias(name) for name, c in held.items()]
    )


def tracker_tables(
    events: DataFrame,
    m: EventMapping = EventMapping(),
    share_daily: bool = False,
    rollup_table: str | None = None,
    measures: Measures | None = None,
) -> TrackerTables:
    """Lazily derived tracker tables over one event log.

    With ``share_daily`` the daily activity, sleep and heart-rate tables are
    projections of one checkpointed :func:`daily_rollup` (built on first use),
    so an analysis combining them scans the log once; otherwise each table is
    its own aggregate, pruned to what the analysis reads. With
    ``rollup_table`` (implies ``share_daily``) the roll-up is instead written
    as a catalog table of that name, bucketed by (user, day), so the joins on
    (Id, day) between the daily tables run without any shuffle. ``measures``
    limits the shared roll-up to what the caller's analyses read
    (``plans.measures.SHARED_MEASURES``); reading another one of it fails.
    """
    t: TrackerTables
    shared: dict[str, DataFrame] = {}
    share_daily = share_daily or rollup_table is not None

    def rollup() -> DataFrame:
        if "r" not in shared:
            from vitalspark.operators.sizing import materialize, write_bucketed

            r = daily_rollup(events, m, measures=measures)
            shared["r"] = write_bucketed(r, rollup_table, ["_user", "_day"]) if rollup_table else materialize(r)
        return shared["r"]

    def activity() -> DataFrame:
        return t.daily_activity

    if share_daily:
        make_activity = lambda: activity_from_rollup(rollup())
        make_sleep = lambda: sleep_from_rollup(rollup())
        make_heart = lambda: heartrate_from_rollup(rollup())
    else:
        make_activity = lambda: daily_activity(events, m)
        make_sleep = lambda: daily_sleep(events, m)
        make_heart = lambda: daily_heartrate(events, m)

    if share_daily and measures is None:  # the whole roll-up is stored for several analyses
        days = lambda parts: days_from_rollup(rollup(), parts)
    else:
        days = lambda parts: user_days(events, parts, m)

    t = TrackerTables(
        events=events,
        days=days,
        daily_activity=make_activity,
        daily_calories=lambda: daily_calories(activity()),
        daily_heartrate=make_heart,
        daily_intensities=lambda: daily_intensities(activity()),
        daily_steps=lambda: daily_steps(activity()),
        daily_sleep=make_sleep,
        minute_mets=lambda: minute_mets(events, m),
        hourly_steps=lambda: hourly_steps(events, m),
        hourly_calories=lambda: hourly_calories(events, m),
    )
    return t


def read_events(
    spark: SparkSession, sf_dir: str, name: str = "events", schema: T.StructType | None = EVENTS
) -> DataFrame:
    """The event log at ``<sf_dir>/<name>.parquet``, with its declared schema;
    columns missing from the files are an error. ``schema=None`` infers it."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if schema is None:
        return spark.read.parquet(path)
    found = {c.lower() for c in spark.read.parquet(path).columns}  # a footer, no rows
    missing = [f.name for f in schema.fields if f.name.lower() not in found]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return spark.read.schema(schema).parquet(path)


def load_tracker_tables(
    spark: SparkSession,
    sf_dir: str,
    m: EventMapping = EventMapping(),
    share_daily: bool = False,
    measures: Measures | None = None,
) -> TrackerTables:
    return tracker_tables(read_events(spark, sf_dir), m, share_daily, measures=measures)
