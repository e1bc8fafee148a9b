"""Structured Streaming forms of the daily roll-ups (event stream -> daily tables)."""

from vitalspark.streaming.rollup import (
    daily_activity_stream,
    daily_heartrate_stream,
    daily_rollup_stream,
    daily_sleep_stream,
    event_time_utc,
    start_rollup,
    stream_checkpoint_location,
)

__all__ = [
    "daily_activity_stream",
    "daily_heartrate_stream",
    "daily_rollup_stream",
    "daily_sleep_stream",
    "event_time_utc",
    "start_rollup",
    "stream_checkpoint_location",
]
