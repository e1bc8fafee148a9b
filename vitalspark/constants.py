"""Fixed values.

These must equal the values the analyses were defined with, so they are kept
here together, as plain text, in their natural order.
"""

# --- fixed values: intensity classification on rounded average METs --------
INTENSITY_CUTS = (10, 16)  # <= 10 Low; (10, 16] Medium; > 16 High
INTENSITY_LABELS = ("Low", "Medium", "High")
INTENSITY_UNKNOWN = "n/d"

# --- fixed values: activity x sleep segmentation ------------------------------
SEGMENT_STEPS_CUT = 10000  # average steps per day
SEGMENT_SLEEP_CUT = 420  # average minutes asleep
SEGMENT_MORE_MORE = "More Active, More Sleep"
SEGMENT_MORE_LESS = "More Active, Less Sleep"
SEGMENT_LESS_MORE = "Less Active, More Sleep"
SEGMENT_LESS_LESS = "Less Active, Less Sleep"
SEGMENT_OTHER = "Other"

# --- fixed values: text formats of the tracker exports ------------------------
DAY_FORMAT = "M/d/yyyy"  # e.g. 4/12/2016
HOUR_STAMP_FORMAT = "M/d/yyyy h:mm:ss a"  # e.g. 4/12/2016 1:00:00 PM
HOUR_TEXT_FORMAT = "HH:mm"  # e.g. 13:00
WEEKDAY_NAME_FORMAT = "E"  # Sun .. Sat

# --- fixed values: user sampling -----------------------------------------------
SAMPLE_SEED = 12
SAMPLE_SIZE = 4
DRILLDOWN_PICK = 3  # the third sampled user is inspected in detail

# --- fixed values: daily trend ---------------------------------------------------
DISTANCE_SCALE = 1000  # km -> m so distance shares an axis with steps
