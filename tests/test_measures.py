"""The measures that each analysis declares are enough, and each is needed."""

import pytest

from vitalspark.plans.analyses import ANALYSES
from vitalspark.plans.measures import DAY_MEASURES, SHARED_MEASURES
from vitalspark.plans.registry import EVENT_PARAMS
from vitalspark.sources import load_tracker_tables, read_events, tracker_tables
from vitalspark.sources.event_log import PARTS, daily_rollup, user_days

from conftest import SF_SMALL, rows


def _close(rs):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs]


@pytest.mark.parametrize("key", sorted(SHARED_MEASURES))
def test_shared_measures_suffice(spark, key):
    full = ANALYSES[key](load_tracker_tables(spark, SF_SMALL, share_daily=True), EVENT_PARAMS)
    pruned = ANALYSES[key](load_tracker_tables(spark, SF_SMALL, share_daily=True, measures=SHARED_MEASURES[key]), EVENT_PARAMS)
    assert _close(rows(pruned)) == _close(rows(full))


@pytest.mark.parametrize("key", ["user_segments", "sleep_on_activity_days"])
def test_every_shared_measure_is_needed(spark, key):
    for part, cols in SHARED_MEASURES[key].items():
        for c in cols:
            less = {**SHARED_MEASURES[key], part: tuple(x for x in cols if x != c)}
            tables = load_tracker_tables(spark, SF_SMALL, share_daily=True, measures=less)
            with pytest.raises(Exception, match=f"{c} is not in the roll-up"):
                ANALYSES[key](tables, EVENT_PARAMS).collect()


@pytest.mark.parametrize("key", ["heartrate_calories", "sleep_vs_calories", "sample_user_drilldown"])
def test_days_of_two_tables_equal_their_join(spark, key):
    from vitalspark.sources import TrackerTables
    from vitalspark.sources.event_log import TABLE_NAMES

    t = load_tracker_tables(spark, SF_SMALL)
    joined = TrackerTables(**{name: getattr(t, name) for name in TABLE_NAMES})  # as from files: no ``days``
    assert _close(rows(ANALYSES[key](t, EVENT_PARAMS))) == _close(rows(ANALYSES[key](joined, EVENT_PARAMS)))


def test_day_measures_name_real_measures(spark):
    events = read_events(spark, SF_SMALL)
    for measures in DAY_MEASURES.values():
        days = user_days(events, measures)
        assert days.columns == ["Id", "Day", *[c for cols in measures.values() for c in cols]]
    with pytest.raises(ValueError, match="unknown parts or measures"):
        daily_rollup(events, measures={"activity": ("NoSuch",)})
    with pytest.raises(ValueError):
        daily_rollup(events, measures={"dreams": ()})


def test_the_pruned_rollup_holds_its_measures_alone(spark):
    events = read_events(spark, SF_SMALL)
    measures = {"activity": ("Calories",), "heart": ("Mean_Value",)}
    pruned = daily_rollup(events, measures=measures)
    assert pruned.columns == ["_user", "_day", "_n_activity", "Calories", "_n_heart", "Mean_Value"]
    whole = daily_rollup(events)
    assert len(whole.columns) == 5 + sum(map(len, PARTS.values()))
    assert rows(pruned) == rows(whole.select(*pruned.columns))


def test_null_users_have_no_days(spark):
    events = read_events(spark, SF_SMALL).selectExpr("event_id", "ts", "nullif(user_id, 3) as user_id", "event_type", "value", "props")
    t = tracker_tables(events)
    assert t.days(DAY_MEASURES["heartrate_calories"]).where("Id is null").count() == 0
    assert events.where("user_id is null").count() > 0
