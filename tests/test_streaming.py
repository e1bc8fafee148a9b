import datetime as dt
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from vitalspark.sources.event_log import daily_activity, daily_heartrate, daily_sleep, read_events
from vitalspark.streaming import (
    daily_activity_stream,
    daily_heartrate_stream,
    daily_sleep_stream,
    start_rollup,
    stream_checkpoint_location,
)

from conftest import SF_SMALL, rows


def _stream(spark):
    schema = read_events(spark, SF_SMALL).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)


def test_streamed_days_equal_batch_days(spark):
    batch_events = read_events(spark, SF_SMALL)
    last_day = batch_events.agg(F.max(F.to_date("ts"))).first()[0]
    out = tempfile.mkdtemp(prefix="vitalspark-stream-")
    cases = [
        ("activity", daily_activity_stream, daily_activity, "ActivityDate"),
        ("heartrate", daily_heartrate_stream, daily_heartrate, "Day"),
    ]
    for name, stream_fn, batch_fn, day_col in cases:
        q = start_rollup(
            stream_fn(_stream(spark)),
            os.path.join(out, name),
            f"rollup_{name}",
            checkpoint_location=os.path.join(out, f"_ck_{name}"),
            available_now=True,
        )
        q.awaitTermination()
        streamed = spark.read.parquet(os.path.join(out, name))
        # Days the watermark (max event time - 1 day) has closed are final.
        closed = F.col(day_col) < F.lit(last_day - dt.timedelta(days=1))
        expected = batch_fn(batch_events).where(closed)
        assert streamed.count() == expected.count() > 0
        assert rows(streamed.select(*expected.columns)) == rows(expected)


def test_sleep_stream_schema_matches_batch(spark):
    s = daily_sleep_stream(_stream(spark))
    assert s.isStreaming
    assert s.columns == daily_sleep(read_events(spark, SF_SMALL)).columns


def test_default_stream_checkpoint_is_stable(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        pytest.skip("spark.checkpoint.dir is not configured")
    assert stream_checkpoint_location(spark, "daily") == os.path.join(root, "streams", "daily")


def test_streamed_sleep_days_equal_batch(spark):
    batch_events = read_events(spark, SF_SMALL)
    last_day = batch_events.agg(F.max(F.to_date("ts"))).first()[0]
    out = tempfile.mkdtemp(prefix="vitalspark-stream-sleep-")
    q = start_rollup(
        daily_sleep_stream(_stream(spark)),
        os.path.join(out, "sleep"),
        "rollup_sleep",
        checkpoint_location=os.path.join(out, "_ck"),
        available_now=True,
    )
    q.awaitTermination()
    day = F.to_date(F.split("SleepDay", " ")[0], "M/d/yyyy")
    closed = day < F.lit(last_day - dt.timedelta(days=1))
    streamed = spark.read.parquet(os.path.join(out, "sleep"))
    expected = daily_sleep(batch_events).where(closed)
    assert streamed.count() == expected.count() > 0
    assert rows(streamed.select(*expected.columns)) == rows(expected)


def test_one_streamed_rollup_feeds_all_daily_tables(spark):
    from vitalspark.sources.event_log import activity_from_rollup, heartrate_from_rollup, sleep_from_rollup
    from vitalspark.streaming import daily_rollup_stream

    batch_events = read_events(spark, SF_SMALL)
    last_day = batch_events.agg(F.max(F.to_date("ts"))).first()[0]
    cutoff = F.lit(last_day - dt.timedelta(days=1))
    out = tempfile.mkdtemp(prefix="vitalspark-stream-rollup-")
    q = start_rollup(
        daily_rollup_stream(_stream(spark)),
        os.path.join(out, "rollup"),
        "rollup_all",
        checkpoint_location=os.path.join(out, "_ck"),
        available_now=True,
    )
    q.awaitTermination()
    rolled = spark.read.parquet(os.path.join(out, "rollup"))
    cases = [
        (activity_from_rollup, daily_activity, F.col("ActivityDate")),
        (heartrate_from_rollup, daily_heartrate, F.col("Day")),
        (sleep_from_rollup, daily_sleep, F.to_date(F.split("SleepDay", " ")[0], "M/d/yyyy")),
    ]
    for from_rollup, batch_fn, day in cases:
        got = from_rollup(rolled)
        want = batch_fn(batch_events).where(day < cutoff)
        assert got.count() == want.count() > 0
        assert rows(got.select(*want.columns)) == rows(want)


def test_stream_with_instant_timestamps(spark):
    # A source whose event time is already a TIMESTAMP (instant) is watermarked
    # directly; in a UTC session its days equal the wall-clock days.
    schema = read_events(spark, SF_SMALL).schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    out = tempfile.mkdtemp(prefix="vitalspark-stream-ltz-")
    q = start_rollup(
        daily_heartrate_stream(stream),
        os.path.join(out, "hr"),
        "rollup_hr_ltz",
        checkpoint_location=os.path.join(out, "_ck"),
        available_now=True,
    )
    q.awaitTermination()
    batch_events = read_events(spark, SF_SMALL)
    last_day = batch_events.agg(F.max(F.to_date("ts"))).first()[0]
    expected = daily_heartrate(batch_events).where(F.col("Day") < F.lit(last_day - dt.timedelta(days=1)))
    streamed = spark.read.parquet(os.path.join(out, "hr"))
    assert rows(streamed.select(*expected.columns)) == rows(expected)
