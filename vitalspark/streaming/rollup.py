"""Daily tracker tables from an event *stream* (Structured Streaming).

The per user-day roll-ups of :mod:`vitalspark.sources.event_log` computed
incrementally: events are grouped into one-day event-time windows under a
watermark, so each finished day is emitted once (append mode) and its state is
dropped - state holds only the days still open, however long the stream runs.
The measures are the same expressions as the batch tables, so the streamed
tables feed the batch analyses unchanged.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalspark.sources.event_log import (
    EventMapping,
    activity_events,
    activity_measures,
    daily_rollup,
    heartrate_events,
    heartrate_measures,
    sleep_day_text,
    sleep_events,
    sleep_measures,
)

EVENT_TIME = "_event_time"


def event_time_utc(ts: str) -> Column:
    """A wall-clock ``timestamp_ntz`` read as a UTC instant.

    Watermarks need an instant (``timestamp``) column; reading the wall clock
    as UTC makes the one-day windows (aligned to UTC midnight) coincide with
    wall-clock days whatever the session time zone.
    """
    c = F.col(ts)
    secs = F.second(c).cast("decimal(8,6)")
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), secs, F.lit("UTC"))


def _by_user_day(events: DataFrame, m: EventMapping, lateness: str, day_name: str):
    ts_type = events.schema[m.ts].dataType.typeName()
    evt = F.col(m.ts) if ts_type == "timestamp" else event_time_utc(m.ts)
    watermarked = events.withColumn(EVENT_TIME, evt).withWatermark(EVENT_TIME, lateness)
    # The window makes the aggregation finishable under the watermark; the day
    # key itself is the time-zone-free date of the wall clock.
    return watermarked.groupBy(
        F.col(m.user).alias("Id"),
        F.window(EVENT_TIME, "1 day").alias("_window"),
        F.to_date(F.col(m.ts)).alias(day_name),
    )


def daily_rollup_stream(events: DataFrame, m: EventMapping = EventMapping(), lateness: str = "1 day") -> DataFrame:
    """All three daily tables in ONE streaming aggregation (one source read,
    one state store): the shared roll-up of
    :func:`vitalspark.sources.event_log.daily_rollup` per one-day event-time
    window. Write it once; ``activity_from_rollup`` / ``sleep_from_rollup`` /
    ``heartrate_from_rollup`` read the three tables from the written output."""
    ts_type = events.schema[m.ts].dataType.typeName()
    evt = F.col(m.ts) if ts_type == "timestamp" else event_time_utc(m.ts)
    watermarked = events.withColumn(EVENT_TIME, evt).withWatermark(EVENT_TIME, lateness)
    window = F.window(EVENT_TIME, "1 day").alias("_window")
    return daily_rollup(watermarked, m, extra_keys=(window,), carry=(F.col(EVENT_TIME),)).drop("_window")


def daily_activity_stream(events: DataFrame, m: EventMapping = EventMapping(), lateness: str = "1 day") -> DataFrame:
    """Streaming form of ``daily_activity``: one row per user-day, emitted once
    the watermark (max event time - ``lateness``) passes the day's end."""
    return (
        _by_user_day(activity_events(events, m), m, lateness, "ActivityDate")
        .agg(*activity_measures(m))
        .drop("_window")
    )


def daily_sleep_stream(events: DataFrame, m: EventMapping = EventMapping(), lateness: str = "1 day") -> DataFrame:
    return (
        _by_user_day(sleep_events(events, m), m, lateness, "_day")
        .agg(*sleep_measures(m))
        .select("Id", sleep_day_text("_day").alias("SleepDay"), "TotalSleepRecords", "TotalMinutesAsleep", "TotalTimeInBed")
    )


def daily_heartrate_stream(events: DataFrame, m: EventMapping = EventMapping(), lateness: str = "1 day") -> DataFrame:
    return (
        _by_user_day(heartrate_events(events, m), m, lateness, "Day")
        .agg(*heartrate_measures(m))
        .drop("_window")
    )


def stream_checkpoint_location(spark, name: str) -> str:
    """``<spark.checkpoint.dir>/streams/<name>``: stable across restarts."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        raise ValueError("pass checkpoint_location or set spark.checkpoint.dir")
    return os.path.join(root, "streams", name)


def start_rollup(
    table: DataFrame,
    path: str,
    name: str,
    checkpoint_location: str | None = None,
    available_now: bool = False,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Append a streamed daily table to Parquet at ``path``.

    The query's checkpoint (offsets and aggregation state) goes to
    ``checkpoint_location``, by default ``<spark.checkpoint.dir>/streams/<name>``:
    a stable path in the shared folder (not the per-application subfolder that
    RDD checkpoints use), so a restarted application resumes where it stopped.
    """
    if checkpoint_location is None:
        checkpoint_location = stream_checkpoint_location(table.sparkSession, name)
    writer = (
        table.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint_location)
        .queryName(name)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
