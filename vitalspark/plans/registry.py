"""Query registry: every analysis over the driver's tables, plus its SQL oracle.

The driver's ``events`` log stands in for the tracker exports (see
:mod:`vitalspark.sources.event_log`). Its scale differs from a tracker's (a
user has ~2 non-sleep events a day, not ~8,000 steps), so the segmentation
cuts are set near the medians of the event-derived averages at sf0.01; all
other parameters keep the analysis defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalspark.functions.columns import round_doubles
from vitalspark.plans import oracle
from vitalspark.plans.analyses import ANALYSES, Params
from vitalspark.plans.measures import SHARED_MEASURES
from vitalspark.plans.tables import TABLE_QUERIES
from vitalspark.sources.event_log import EventMapping, TrackerTables, load_tracker_tables

EVENT_PARAMS = Params(steps_cut=2.15, sleep_cut=59.4)
EVENT_MAPPING = EventMapping()

#: Fan-outs: their only double comes as it is from daily sleep, so it is rounded
#: there, once a sleep row instead of once a copy.
ROUNDED_FIRST = frozenset({"sleep_on_activity_days", "sleep_on_activity_days_join"})

QueryFn = Callable[[SparkSession, str], DataFrame]


def run_analysis(
    spark: SparkSession, sf_dir: str, key: str, params: Params = EVENT_PARAMS, sleep_digits: int | None = None
) -> DataFrame:
    """The analysis ``key`` over the event log; with ``sleep_digits``, the doubles of
    its daily sleep are rounded to so many decimals first."""
    shared = SHARED_MEASURES.get(key)
    tables = load_tracker_tables(spark, sf_dir, EVENT_MAPPING, share_daily=shared is not None, measures=shared)
    if sleep_digits is not None:
        tables = _with_rounded_sleep(tables, sleep_digits)
    return (ANALYSES | TABLE_QUERIES)[key](tables, params)


def _with_rounded_sleep(tables: TrackerTables, digits: int) -> TrackerTables:
    given = {name: lambda name=name: getattr(tables, name) for name in tables.names}
    given["daily_sleep"] = lambda: round_doubles(tables.daily_sleep, digits)
    return TrackerTables(tables.events, tables.days, tables.rejects, **given)


def _query(key: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if key in ROUNDED_FIRST:
            return run_analysis(spark, sf_dir, key, sleep_digits=oracle.DIGITS)
        return round_doubles(run_analysis(spark, sf_dir, key), oracle.DIGITS)

    run.__name__ = key
    return run


def queries() -> dict[str, QueryFn]:
    return {key: _query(key) for key in ANALYSES | TABLE_QUERIES}


def oracle_sql() -> dict[str, str]:
    sql = oracle.oracle_sql(EVENT_PARAMS, EVENT_MAPPING)
    return {key: sql[key] for key in ANALYSES | TABLE_QUERIES if key in sql}
