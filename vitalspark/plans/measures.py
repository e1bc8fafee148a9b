"""What each analysis reads of the daily tables.

``DAY_MEASURES``: analyses of user-days that two tables share. Over an event log
they come from one aggregation of these measures alone (``TrackerTables.days``).

``SHARED_MEASURES``: analyses that use two daily tables in different ways, and so
read one roll-up twice; it is checkpointed with these measures alone.

``tests/test_measures.py`` checks that each entry suffices and that each measure
in it is needed.
"""

from __future__ import annotations

from vitalspark.operators.clean import DISTANCE_PARTS
from vitalspark.operators.joins import MINUTE_COLUMNS
from vitalspark.sources.event_log import Measures

DAY_MEASURES: dict[str, Measures] = {
    "heartrate_calories": {"activity": ("Calories",), "heart": ("Mean_Value",)},
    "sleep_vs_calories": {
        "activity": (*DISTANCE_PARTS, "Calories"),
        "sleep": ("TotalMinutesAsleep", "TotalTimeInBed"),
    },
    "drilldown": {"activity": (*MINUTE_COLUMNS, "Calories"), "heart": ()},
}

_SEGMENTS: Measures = {"activity": ("TotalSteps", *DISTANCE_PARTS), "sleep": ("TotalMinutesAsleep",)}
_FAN_OUT: Measures = {"activity": DISTANCE_PARTS, "sleep": ("TotalMinutesAsleep",)}

SHARED_MEASURES: dict[str, Measures] = {
    "sleep_on_activity_days": _FAN_OUT,
    "sleep_on_activity_days_join": _FAN_OUT,
    "user_segments": _SEGMENTS,
    "user_segments_join": _SEGMENTS,
    "consecutive_ids": _SEGMENTS,
    "segment_share": _SEGMENTS,
}
