"""The named analyses, each one DataFrame built from the tracker tables.

Every function takes :class:`TrackerTables` and :class:`Params` and returns a
lazy DataFrame (except where an operator measures a small side table before
broadcasting it). Presentation steps of the original analyses (charts, final
sorts) are left out; the frames behind them are what is built here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark import operators as ops
from vitalspark.constants import (
    DRILLDOWN_PICK,
    INTENSITY_CUTS,
    SAMPLE_SEED,
    SAMPLE_SIZE,
    SEGMENT_SLEEP_CUT,
    SEGMENT_STEPS_CUT,
)
from vitalspark.operators.clean import ACTIVITY_CLEAN_COLUMNS
from vitalspark.plans.measures import DAY_MEASURES, SHARED_MEASURES
from vitalspark.sources.event_log import TrackerTables


@dataclass(frozen=True)
class Params:
    steps_cut: float = SEGMENT_STEPS_CUT
    sleep_cut: float = SEGMENT_SLEEP_CUT
    intensity_cuts: tuple[float, float] = INTENSITY_CUTS
    sample_size: int = SAMPLE_SIZE
    sample_seed: int = SAMPLE_SEED
    drilldown_pick: int = DRILLDOWN_PICK
    strict: bool = True  # False: unparsable dates / stamps become NULL instead of failing


Analysis = Callable[[TrackerTables, Params], DataFrame]


# --- cleaning and quality ---------------------------------------------------------


def users(t: TrackerTables, p: Params) -> DataFrame:
    return ops.distinct_users(t.daily_activity)


def activity_clean(t: TrackerTables, p: Params) -> DataFrame:
    return ops.activity_clean(t.daily_activity, strict=p.strict)


def null_count(t: TrackerTables, p: Params) -> DataFrame:
    return ops.null_counts(activity_clean(t, p), ACTIVITY_CLEAN_COLUMNS)


def duplicate_activity_days(t: TrackerTables, p: Params) -> DataFrame:
    return ops.duplicates(activity_clean(t, p), ["Id", "Date", "TotalSteps"])


def _event_keys(t: TrackerTables) -> DataFrame:
    if t.events is None:
        raise ValueError("this check needs the raw event log")
    return t.events.select("user_id", F.to_date("ts").alias("Date"), "event_type")


# Analyses that read the raw event log rather than the tracker tables.
NEEDS_EVENTS = ("duplicates", "duplicate_event_count")

# Analyses that use two daily tables of an event log in different ways: their
# roll-up of the log is stored once, with the measures that they read.
SHARED_DAILY = frozenset(SHARED_MEASURES)


def duplicates(t: TrackerTables, p: Params) -> DataFrame:
    """The duplicate-key check on the raw event log, keyed by (user, day, kind)."""
    return ops.duplicates(_event_keys(t), ["user_id", "Date", "event_type"])


def duplicate_count(t: TrackerTables, p: Params) -> DataFrame:
    """The printed duplicate check as a one-row frame (activity key groups)."""
    return ops.duplicate_summary(activity_clean(t, p), ["Id", "Date", "TotalSteps"])


def duplicate_event_count(t: TrackerTables, p: Params) -> DataFrame:
    """The same one-row summary over the raw event log keys."""
    return ops.duplicate_summary(_event_keys(t), ["user_id", "Date", "event_type"])


def mets_clean(t: TrackerTables, p: Params) -> DataFrame:
    return ops.mets_clean(t.minute_mets)


def sleep_clean(t: TrackerTables, p: Params) -> DataFrame:
    return ops.sleep_clean(t.daily_sleep, strict=p.strict)


def hourly_split(t: TrackerTables, p: Params) -> DataFrame:
    return ops.hourly_split(t.hourly_steps, "StepTotal", "Steps", strict=p.strict)


def hourly_calories_split(t: TrackerTables, p: Params) -> DataFrame:
    return ops.hourly_split(t.hourly_calories, "Calories", strict=p.strict)


def intensities_clean(t: TrackerTables, p: Params) -> DataFrame:
    return ops.intensities_clean(t.daily_intensities)


# --- 4.1 - 4.4: averages and totals ----------------------------------------------------


def weekday_avg(t: TrackerTables, p: Params) -> DataFrame:
    return ops.weekday_average(activity_clean(t, p))


def hour_avg_calories(t: TrackerTables, p: Params) -> DataFrame:
    return ops.hour_of_day_average(hourly_calories_split(t, p), "Calories", "AvgCalories")


def user_totals(t: TrackerTables, p: Params) -> DataFrame:
    return ops.user_totals(activity_clean(t, p))


def user_totals_fit(t: TrackerTables, p: Params) -> DataFrame:
    totals = user_totals(t, p).select("Id", "TotalCalories", "TotalSteps")
    return ops.fit_and_predict(totals, x="TotalCalories", y="TotalSteps")


def hour_avg_steps(t: TrackerTables, p: Params) -> DataFrame:
    return ops.hour_text_average(hourly_split(t, p), "Steps", "avg_steps")


def daily_trend(t: TrackerTables, p: Params) -> DataFrame:
    return ops.daily_trend(activity_clean(t, p))


# --- 4.5 - 4.6: intensity ------------------------------------------------------------


def intensity_level(t: TrackerTables, p: Params) -> DataFrame:
    return ops.intensity_level(mets_clean(t, p), cuts=p.intensity_cuts)


def intensity_share(t: TrackerTables, p: Params) -> DataFrame:
    return ops.share_of_total(intensity_level(t, p), "IntensityLevel", "AvgMETs")


def mets_frequency(t: TrackerTables, p: Params) -> DataFrame:
    return ops.frequency(mets_clean(t, p), "METs", "Frequency")


def mets_frequency_fit(t: TrackerTables, p: Params) -> DataFrame:
    return ops.fit_and_predict(mets_frequency(t, p), x="METs", y="Frequency")


# --- 4.7 - 4.9: sleep -------------------------------------------------------------------


def sleep_weekday_avg(t: TrackerTables, p: Params) -> DataFrame:
    return ops.sleep_weekday_average(sleep_clean(t, p))


def sleep_on_activity_days(t: TrackerTables, p: Params) -> DataFrame:
    return ops.sleep_on_activity_days(activity_clean(t, p), sleep_clean(t, p))


def sleep_on_activity_days_join(t: TrackerTables, p: Params) -> DataFrame:
    return ops.sleep_on_activity_days_join(activity_clean(t, p), sleep_clean(t, p))


def user_segments(t: TrackerTables, p: Params) -> DataFrame:
    return ops.user_segments(activity_clean(t, p), sleep_clean(t, p), p.steps_cut, p.sleep_cut)


def user_segments_join(t: TrackerTables, p: Params) -> DataFrame:
    return ops.user_segments_join(activity_clean(t, p), sleep_clean(t, p), p.steps_cut, p.sleep_cut)


def consecutive_ids(t: TrackerTables, p: Params) -> DataFrame:
    return ops.dense_index(user_segments(t, p), "Id", "Id_Consecutive")


def segment_share(t: TrackerTables, p: Params) -> DataFrame:
    return ops.share_of_total(user_segments(t, p), "UserSegment", "AvgMinutesAsleep")


def sleep_vs_calories(t: TrackerTables, p: Params) -> DataFrame:
    if t.days is not None:
        return ops.sleep_vs_calories_of_days(t.days(DAY_MEASURES["sleep_vs_calories"]))
    return ops.sleep_vs_calories(activity_clean(t, p), sleep_clean(t, p))


def sleep_calories_fit(t: TrackerTables, p: Params) -> DataFrame:
    per_user = sleep_vs_calories(t, p).select("Id", "Calories", "TotalMinutesAsleep")
    return ops.fit_and_predict(per_user, x="Calories", y="TotalMinutesAsleep")


# --- 4.10: heart rate ---------------------------------------------------------------------


def heartrate_calories(t: TrackerTables, p: Params) -> DataFrame:
    if t.days is not None:
        return ops.heartrate_calories_of_days(t.days(DAY_MEASURES["heartrate_calories"]))
    return ops.heartrate_calories(t.daily_activity, t.daily_heartrate, strict=p.strict)


def heartrate_fit_by_user(t: TrackerTables, p: Params) -> DataFrame:
    return ops.fit_line(heartrate_calories(t, p), x="AvgHeartrate", y="Calories", by=["Id"])


def sample_users(t: TrackerTables, p: Params) -> DataFrame:
    return ops.sample_keys(heartrate_calories(t, p), "Id", p.sample_size, p.sample_seed)


def sample_user_days(t: TrackerTables, p: Params) -> DataFrame:
    return ops.sample_key_rows(heartrate_calories(t, p), "Id", p.sample_size, p.sample_seed)


def sample_user_fits(t: TrackerTables, p: Params) -> DataFrame:
    return ops.fit_line(sample_user_days(t, p), x="AvgHeartrate", y="Calories", by=["Id", "SampleRank"])


def sample_user_predictions(t: TrackerTables, p: Params) -> DataFrame:
    """Each sampled user's own line evaluated at each of their days."""
    days = ops.materialize(sample_user_days(t, p))  # k users' days, read twice
    model = ops.fit_line(days, x="AvgHeartrate", y="Calories", by=["Id"])
    return ops.predict_line(days, model, x="AvgHeartrate", out="FittedCalories", by=["Id"])


def sample_user_drilldown(t: TrackerTables, p: Params) -> DataFrame:
    drawn = ops.drawn_keys(sample_users(t, p))
    picked = {key: rank for key, rank in drawn.items() if rank == p.drilldown_pick}
    if t.days is not None:
        days = ops.rows_of_keys(t.days(DAY_MEASURES["drilldown"]), picked)
        return days.select("Id", "Day", *ops.MINUTE_COLUMNS, "Calories")
    days = ops.rows_of_keys(heartrate_calories(t, p), picked)
    return ops.drilldown(days, ops.rows_of_keys(t.daily_activity, picked), strict=p.strict)


ANALYSES: dict[str, Analysis] = {
    "users": users,
    "activity_clean": activity_clean,
    "null_count": null_count,
    "duplicates": duplicates,
    "duplicate_activity_days": duplicate_activity_days,
    "duplicate_count": duplicate_count,
    "duplicate_event_count": duplicate_event_count,
    "mets_clean": mets_clean,
    "sleep_clean": sleep_clean,
    "hourly_split": hourly_split,
    "hourly_calories_split": hourly_calories_split,
    "intensities_clean": intensities_clean,
    "weekday_avg": weekday_avg,
    "hour_avg_calories": hour_avg_calories,
    "user_totals": user_totals,
    "user_totals_fit": user_totals_fit,
    "hour_avg_steps": hour_avg_steps,
    "daily_trend": daily_trend,
    "intensity_level": intensity_level,
    "intensity_share": intensity_share,
    "mets_frequency": mets_frequency,
    "mets_frequency_fit": mets_frequency_fit,
    "sleep_weekday_avg": sleep_weekday_avg,
    "sleep_on_activity_days": sleep_on_activity_days,
    "sleep_on_activity_days_join": sleep_on_activity_days_join,
    "user_segments": user_segments,
    "user_segments_join": user_segments_join,
    "consecutive_ids": consecutive_ids,
    "segment_share": segment_share,
    "sleep_vs_calories": sleep_vs_calories,
    "sleep_calories_fit": sleep_calories_fit,
    "heartrate_calories": heartrate_calories,
    "heartrate_fit_by_user": heartrate_fit_by_user,
    "sample_users": sample_users,
    "sample_user_days": sample_user_days,
    "sample_user_fits": sample_user_fits,
    "sample_user_predictions": sample_user_predictions,
    "sample_user_drilldown": sample_user_drilldown,
}


# The order in which the original analyses present each result (their final
# sort); the frames above are unordered and sorting is a presentation step.
PRESENTATION_ORDER: dict[str, tuple[str, ...]] = {
    "activity_clean": ("Date", "Id"),
    "sleep_clean": ("Date", "Id"),
    "intensities_clean": ("Id", "Date"),
    "weekday_avg": ("WeekDayN", "WeekDay"),
    "hour_avg_calories": ("Hour",),
    "hour_avg_steps": ("Hour",),
    "daily_trend": ("Date",),
    "mets_frequency": ("METs",),
    "sleep_weekday_avg": ("WeekDayN",),
    "sleep_on_activity_days": ("Date",),
    "sleep_on_activity_days_join": ("Date",),
    "consecutive_ids": ("Id_Consecutive",),
    "sample_users": ("SampleRank",),
    "sample_user_days": ("SampleRank", "Day"),
}


def present(key: str, df: DataFrame) -> DataFrame:
    """Apply the analysis' presentation order (a global sort: range-partitioned,
    so it scales, but it is a full shuffle - use it for display or export)."""
    order = PRESENTATION_ORDER.get(key)
    return df.orderBy(*order) if order else df
