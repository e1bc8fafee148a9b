"""Independent SQL for every registered query, in DuckDB's dialect.

Each statement starts from the raw ``events`` view, re-derives the tracker
tables with plain SQL, and computes the analysis the straightforward way
(plain joins, window functions) - the forms the Spark plans avoid at scale.
Floating-point outputs are rounded to ``DIGITS`` decimals on both sides.

Dialect notes: DuckDB's ``dayofweek`` is 0 = Sunday (Spark: 1), ``strftime``
replaces ``date_format``, lists are 1-based, integer sums are HUGEINT (cast to
BIGINT), and ``regr_slope`` is NaN where Spark returns NULL.
"""

from __future__ import annotations

from vitalspark.constants import (
    DISTANCE_SCALE,
    INTENSITY_LABELS,
    INTENSITY_UNKNOWN,
    SEGMENT_LESS_LESS,
    SEGMENT_LESS_MORE,
    SEGMENT_MORE_LESS,
    SEGMENT_MORE_MORE,
    SEGMENT_OTHER,
)
from vitalspark.plans.analyses import Params
from vitalspark.sources.event_log import EventMapping

DIGITS = 6


def _views(m: EventMapping, p: Params) -> str:
    lo, hi = p.intensity_cuts
    low, medium, high = INTENSITY_LABELS
    return f"""
daily_activity AS (
  SELECT user_id AS Id, CAST(ts AS DATE) AS ActivityDate,
    CAST(count(*) AS INTEGER) AS TotalSteps,
    sum(value) AS TotalDistance,
    coalesce(sum(CASE WHEN event_type = '{m.very_kind}' THEN value END), 0.0) AS VeryActiveDistance,
    coalesce(sum(CASE WHEN event_type = '{m.moderate_kind}' THEN value END), 0.0) AS ModeratelyActiveDistance,
    coalesce(sum(CASE WHEN event_type = '{m.light_kind}' THEN value END), 0.0) AS LightActiveDistance,
    coalesce(sum(CASE WHEN event_type = '{m.sedentary_kind}' THEN value END), 0.0) AS SedentaryActiveDistance,
    CAST(count(CASE WHEN event_type = '{m.very_kind}' THEN 1 END) AS INTEGER) AS VeryActiveMinutes,
    CAST(count(CASE WHEN event_type = '{m.moderate_kind}' THEN 1 END) AS INTEGER) AS FairlyActiveMinutes,
    CAST(count(CASE WHEN event_type = '{m.light_kind}' THEN 1 END) AS INTEGER) AS LightlyActiveMinutes,
    CAST(count(CASE WHEN event_type = '{m.sedentary_kind}' THEN 1 END) AS INTEGER) AS SedentaryMinutes,
    sum(value) * {m.calories_per_value} AS Calories
  FROM events WHERE event_type <> '{m.sleep_kind}'
  GROUP BY user_id, CAST(ts AS DATE)
),
daily_sleep AS (
  SELECT Id, strftime(d, '%-m/%-d/%Y') || ' 12:00:00 AM' AS SleepDay,
    TotalSleepRecords, TotalMinutesAsleep, TotalTimeInBed
  FROM (
    SELECT user_id AS Id, CAST(ts AS DATE) AS d, CAST(count(*) AS INTEGER) AS TotalSleepRecords,
      sum(value) AS TotalMinutesAsleep, sum(value) + {m.bed_minutes_per_record} * count(*) AS TotalTimeInBed
    FROM events WHERE event_type = '{m.sleep_kind}'
    GROUP BY user_id, CAST(ts AS DATE))
),
daily_heartrate AS (
  SELECT user_id AS Id, CAST(ts AS DATE) AS Day, avg(value) AS Mean_Value,
    CAST(count(*) AS INTEGER) AS Entry_Count
  FROM events WHERE event_type = '{m.heart_kind}'
  GROUP BY user_id, CAST(ts AS DATE)
),
minute_mets AS (
  SELECT user_id AS Id, CAST(ts AS DATE) AS Activity, strftime(ts, '%H:%M') AS Minute,
    CAST(floor(value / {m.mets_divisor}) AS INTEGER) AS METs
  FROM events
),
hourly AS (
  SELECT user_id AS Id, strftime(date_trunc('hour', ts), '%-m/%-d/%Y %-I:%M:%S %p') AS ActivityHour,
    CAST(count(*) AS INTEGER) AS StepTotal, sum(value) AS Calories
  FROM events GROUP BY user_id, date_trunc('hour', ts)
),
daily_intensities AS (
  SELECT Id, strftime(ActivityDate, '%-m/%-d/%Y') AS ActivityDay, SedentaryMinutes, LightlyActiveMinutes,
    FairlyActiveMinutes, VeryActiveMinutes, SedentaryActiveDistance, LightActiveDistance,
    ModeratelyActiveDistance, VeryActiveDistance
  FROM daily_activity
),
activity_clean AS (
  SELECT * FROM (
    SELECT Id, ActivityDate AS Date, CAST(TotalSteps AS INTEGER) AS TotalSteps, TotalDistance,
      SedentaryActiveDistance, LightActiveDistance, ModeratelyActiveDistance, VeryActiveDistance,
      SedentaryMinutes, LightlyActiveMinutes, FairlyActiveMinutes, VeryActiveMinutes, Calories,
      strftime(ActivityDate, '%a') AS WeekDay,
      CAST(dayofweek(ActivityDate) + 1 AS INTEGER) AS WeekDayN,
      VeryActiveDistance + ModeratelyActiveDistance + LightActiveDistance + SedentaryActiveDistance
        AS SumOfDistances
    FROM daily_activity)
  WHERE SumOfDistances > 0
),
sleep_clean AS (
  SELECT Id, d AS Date, TotalMinutesAsleep, TotalTimeInBed,
    CAST(dayofweek(d) + 1 AS INTEGER) AS WeekDayN, strftime(d, '%a') AS WeekDay
  FROM (SELECT *, CAST(strptime(string_split(SleepDay, ' ')[1], '%-m/%-d/%Y') AS DATE) AS d
        FROM daily_sleep)
),
mets_clean AS (
  SELECT Id, Activity AS Date, Minute AS Time, METs FROM minute_mets
),
hourly_parsed AS (
  SELECT Id, strptime(ActivityHour, '%-m/%-d/%Y %-I:%M:%S %p') AS p, StepTotal, Calories FROM hourly
),
hourly_steps_split AS (
  SELECT Id, strftime(p, '%-m/%-d/%Y') AS Day, strftime(p, '%H:%M') AS Hour, StepTotal AS Steps
  FROM hourly_parsed
),
hourly_calories_split AS (
  SELECT Id, strftime(p, '%-m/%-d/%Y') AS Day, strftime(p, '%H:%M') AS Hour, Calories
  FROM hourly_parsed
),
user_totals AS (
  SELECT Id, CAST(sum(TotalSteps) AS BIGINT) AS TotalSteps,
    CAST(sum(LightlyActiveMinutes) AS BIGINT) AS TotalLightlyActiveMinutes,
    CAST(sum(FairlyActiveMinutes) AS BIGINT) AS TotalFairlyActiveMinutes,
    CAST(sum(VeryActiveMinutes) AS BIGINT) AS TotalVeryActiveMinutes,
    sum(Calories) AS TotalCalories
  FROM activity_clean GROUP BY Id
),
intensity_level AS (
  SELECT Id, AvgMETs,
    CASE WHEN AvgMETs <= {lo} THEN '{low}'
         WHEN AvgMETs > {lo} AND AvgMETs <= {hi} THEN '{medium}'
         WHEN AvgMETs > {hi} THEN '{high}'
         ELSE '{INTENSITY_UNKNOWN}' END AS IntensityLevel
  FROM (SELECT Id, round(avg(METs)) AS AvgMETs FROM mets_clean GROUP BY Id)
),
mets_frequency AS (
  SELECT METs, count(*) AS Frequency FROM mets_clean GROUP BY METs
),
user_segments AS (
  SELECT Id, AvgSteps, AvgMinutesAsleep,
    CASE WHEN AvgSteps >= {p.steps_cut} AND AvgMinutesAsleep >= {p.sleep_cut} THEN '{SEGMENT_MORE_MORE}'
         WHEN AvgSteps >= {p.steps_cut} AND AvgMinutesAsleep < {p.sleep_cut} THEN '{SEGMENT_MORE_LESS}'
         WHEN AvgSteps < {p.steps_cut} AND AvgMinutesAsleep >= {p.sleep_cut} THEN '{SEGMENT_LESS_MORE}'
         WHEN AvgSteps < {p.steps_cut} AND AvgMinutesAsleep < {p.sleep_cut} THEN '{SEGMENT_LESS_LESS}'
         ELSE '{SEGMENT_OTHER}' END AS UserSegment
  FROM (SELECT a.Id, avg(a.TotalSteps) AS AvgSteps, avg(s.TotalMinutesAsleep) AS AvgMinutesAsleep
        FROM activity_clean a JOIN sleep_clean s ON a.Date = s.Date
        GROUP BY a.Id)
),
sleep_vs_calories AS (
  SELECT a.Id, sum(s.TotalMinutesAsleep) AS TotalMinutesAsleep, sum(s.TotalTimeInBed) AS TotalTimeInBed,
    sum(a.Calories) AS Calories
  FROM activity_clean a JOIN sleep_clean s ON a.Id = s.Id AND a.Date = s.Date
  GROUP BY a.Id
),
heartrate_calories AS (
  SELECT h.Id, h.Day, a.Calories, h.Mean_Value AS AvgHeartrate
  FROM daily_activity a JOIN daily_heartrate h ON a.ActivityDate = h.Day AND a.Id = h.Id
),
sample_users AS (
  SELECT Id, CAST(row_number() OVER (ORDER BY h, Id) AS INTEGER) AS SampleRank
  FROM (SELECT Id, md5(concat_ws(':', '{p.sample_seed}', CAST(Id AS VARCHAR))) AS h
        FROM (SELECT DISTINCT Id FROM heartrate_calories WHERE Id IS NOT NULL)
        ORDER BY h, Id LIMIT {p.sample_size})
),
sample_user_days AS (
  SELECT d.Id, d.Day, d.Calories, d.AvgHeartrate, u.SampleRank
  FROM heartrate_calories d JOIN sample_users u ON d.Id = u.Id
)"""


def _slope(y: str, x: str) -> str:
    # DuckDB: NaN slope / NULL intercept for constant x; Spark: NULL for both.
    return f"CASE WHEN isnan(regr_slope({y}, {x})) THEN NULL ELSE regr_slope({y}, {x}) END"


def _intercept(y: str, x: str) -> str:
    return f"CASE WHEN isnan(regr_slope({y}, {x})) THEN NULL ELSE regr_intercept({y}, {x}) END"


def _fit(table: str, keys: list[str], x: str, y: str) -> str:
    cols = ", ".join(f"t.{c}" for c in keys + [x, y])
    return f"""
SELECT {cols}, m.Slope, m.Intercept, t.{x} * m.Slope + m.Intercept AS Fitted
FROM {table} t,
  (SELECT {_slope(y, x)} AS Slope, {_intercept(y, x)} AS Intercept FROM {table}) m"""


def _share(table: str, label: str, metric: str) -> str:
    return f"""
SELECT {label}, {metric}, {metric} / sum({metric}) OVER () AS Share
FROM (SELECT {label}, sum({metric}) AS {metric} FROM {table} GROUP BY {label})"""


def _half_up(expr: str, digits: int) -> str:
    # Snap to 10 decimals, then round the decimal half away from zero: the
    # same rule as the Spark side, so exact ties (x.xxxxxx5) agree.
    return f"CAST(round(TRY_CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _rounded(body: str, cols: list[str], doubles: set[str]) -> str:
    sel = ", ".join(f"{_half_up(c, DIGITS)} AS {c}" if c in doubles else c for c in cols)
    return f"SELECT {sel} FROM ({body}) q"


ACTIVITY_COLS = [
    "Id", "Date", "TotalSteps", "TotalDistance", "SedentaryActiveDistance", "LightActiveDistance",
    "ModeratelyActiveDistance", "VeryActiveDistance", "SedentaryMinutes", "LightlyActiveMinutes",
    "FairlyActiveMinutes", "VeryActiveMinutes", "Calories", "WeekDay", "WeekDayN", "SumOfDistances",
]
ACTIVITY_DOUBLES = {
    "TotalDistance", "SedentaryActiveDistance", "LightActiveDistance", "ModeratelyActiveDistance",
    "VeryActiveDistance", "Calories", "SumOfDistances",
}


def _queries(p: Params) -> dict[str, tuple[str, list[str], set[str]]]:
    null_cols = ", ".join(
        f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}_nulls" for c in ACTIVITY_COLS
    )
    seg_cols = ["Id", "AvgSteps", "AvgMinutesAsleep", "UserSegment"]
    seg_doubles = {"AvgSteps", "AvgMinutesAsleep"}
    fit_doubles = {"Slope", "Intercept", "Fitted"}
    return {
        "users": ("SELECT DISTINCT Id FROM daily_activity", ["Id"], set()),
        "activity_clean": ("SELECT * FROM activity_clean", ACTIVITY_COLS, ACTIVITY_DOUBLES),
        "null_count": (
            f"SELECT CAST(count(*) AS BIGINT) AS row_count, {null_cols} FROM activity_clean",
            ["row_count"] + [f"{c}_nulls" for c in ACTIVITY_COLS],
            set(),
        ),
        "duplicates": (
            """SELECT user_id, CAST(ts AS DATE) AS Date, event_type, count(*) AS Count
               FROM events GROUP BY user_id, CAST(ts AS DATE), event_type HAVING count(*) > 1""",
            ["user_id", "Date", "event_type", "Count"],
            set(),
        ),
        "duplicate_activity_days": (
            """SELECT Id, Date, TotalSteps, count(*) AS Count FROM activity_clean
               GROUP BY Id, Date, TotalSteps HAVING count(*) > 1""",
            ["Id", "Date", "TotalSteps", "Count"],
            set(),
        ),
        "duplicate_count": (
            """SELECT CAST(count(*) AS BIGINT) AS duplicate_groups, CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_rows
               FROM (SELECT count(*) AS c FROM activity_clean GROUP BY Id, Date, TotalSteps HAVING count(*) > 1)""",
            ["duplicate_groups", "duplicate_rows"],
            set(),
        ),
        "duplicate_event_count": (
            """SELECT CAST(count(*) AS BIGINT) AS duplicate_groups, CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_rows
               FROM (SELECT count(*) AS c FROM events GROUP BY user_id, CAST(ts AS DATE), event_type
                     HAVING count(*) > 1)""",
            ["duplicate_groups", "duplicate_rows"],
            set(),
        ),
        "mets_clean": ("SELECT * FROM mets_clean", ["Id", "Date", "Time", "METs"], set()),
        "sleep_clean": (
            "SELECT * FROM sleep_clean",
            ["Id", "Date", "TotalMinutesAsleep", "TotalTimeInBed", "WeekDayN", "WeekDay"],
            {"TotalMinutesAsleep", "TotalTimeInBed"},
        ),
        "hourly_split": ("SELECT * FROM hourly_steps_split", ["Id", "Day", "Hour", "Steps"], set()),
        "hourly_calories_split": (
            "SELECT * FROM hourly_calories_split",
            ["Id", "Day", "Hour", "Calories"],
            {"Calories"},
        ),
        "intensities_clean": (
            "SELECT Id, ActivityDay AS Date, * EXCLUDE (Id, ActivityDay) FROM daily_intensities",
            [
                "Id", "Date", "SedentaryMinutes", "LightlyActiveMinutes", "FairlyActiveMinutes",
                "VeryActiveMinutes", "SedentaryActiveDistance", "LightActiveDistance",
                "ModeratelyActiveDistance", "VeryActiveDistance",
            ],
            {"SedentaryActiveDistance", "LightActiveDistance", "ModeratelyActiveDistance", "VeryActiveDistance"},
        ),
        "weekday_avg": (
            """SELECT WeekDayN, WeekDay, avg(TotalSteps) AS AvgSteps, avg(TotalDistance) AS AvgDistance,
                 avg(Calories) AS AvgCalories
               FROM activity_clean GROUP BY WeekDayN, WeekDay""",
            ["WeekDayN", "WeekDay", "AvgSteps", "AvgDistance", "AvgCalories"],
            {"AvgSteps", "AvgDistance", "AvgCalories"},
        ),
        "hour_avg_calories": (
            """SELECT CAST(string_split(Hour, ':')[1] AS INTEGER) AS Hour, avg(Calories) AS AvgCalories
               FROM hourly_calories_split GROUP BY 1""",
            ["Hour", "AvgCalories"],
            {"AvgCalories"},
        ),
        "user_totals": (
            "SELECT * FROM user_totals",
            ["Id", "TotalSteps", "TotalLightlyActiveMinutes", "TotalFairlyActiveMinutes",
             "TotalVeryActiveMinutes", "TotalCalories"],
            {"TotalCalories"},
        ),
        "user_totals_fit": (
            _fit("user_totals", ["Id"], "TotalCalories", "TotalSteps"),
            ["Id", "TotalCalories", "TotalSteps", "Slope", "Intercept", "Fitted"],
            {"TotalCalories"} | fit_doubles,
        ),
        "hour_avg_steps": (
            "SELECT Hour, avg(Steps) AS avg_steps FROM hourly_steps_split GROUP BY Hour",
            ["Hour", "avg_steps"],
            {"avg_steps"},
        ),
        "daily_trend": (
            # sums and averages of decimals: the log's values have two of them
            f"""SELECT Date, round(avg(TotalSteps)) AS avg_steps,
                 round(avg({DISTANCE_SCALE} * CAST(TotalDistance AS DECIMAL(18, 2)))) AS avg_distance,
                 round(avg(CAST(Calories AS DECIMAL(18, 2)))) AS avg_calories
               FROM activity_clean GROUP BY Date""",
            ["Date", "avg_steps", "avg_distance", "avg_calories"],
            {"avg_steps", "avg_distance", "avg_calories"},
        ),
        "intensity_level": (
            "SELECT * FROM intensity_level",
            ["Id", "AvgMETs", "IntensityLevel"],
            {"AvgMETs"},
        ),
        "intensity_share": (
            _share("intensity_level", "IntensityLevel", "AvgMETs"),
            ["IntensityLevel", "AvgMETs", "Share"],
            {"AvgMETs", "Share"},
        ),
        "mets_frequency": ("SELECT * FROM mets_frequency", ["METs", "Frequency"], set()),
        "mets_frequency_fit": (
            _fit("mets_frequency", [], "METs", "Frequency"),
            ["METs", "Frequency", "Slope", "Intercept", "Fitted"],
            fit_doubles,
        ),
        "sleep_weekday_avg": (
            """SELECT WeekDayN, WeekDay, round(avg(CAST(TotalMinutesAsleep AS DECIMAL(18, 2)))) AS AvgSleepMinutes
               FROM sleep_clean GROUP BY WeekDayN, WeekDay""",
            ["WeekDayN", "WeekDay", "AvgSleepMinutes"],
            {"AvgSleepMinutes"},
        ),
        "sleep_on_activity_days": (
            """SELECT s.Date, s.TotalMinutesAsleep FROM activity_clean a JOIN sleep_clean s ON a.Date = s.Date""",
            ["Date", "TotalMinutesAsleep"],
            {"TotalMinutesAsleep"},
        ),
        "user_segments": ("SELECT * FROM user_segments", seg_cols, seg_doubles),
        "consecutive_ids": (
            "SELECT *, dense_rank() OVER (ORDER BY Id) AS Id_Consecutive FROM user_segments",
            seg_cols + ["Id_Consecutive"],
            seg_doubles,
        ),
        "segment_share": (
            _share("user_segments", "UserSegment", "AvgMinutesAsleep"),
            ["UserSegment", "AvgMinutesAsleep", "Share"],
            {"AvgMinutesAsleep", "Share"},
        ),
        "sleep_vs_calories": (
            "SELECT * FROM sleep_vs_calories",
            ["Id", "TotalMinutesAsleep", "TotalTimeInBed", "Calories"],
            {"TotalMinutesAsleep", "TotalTimeInBed", "Calories"},
        ),
        "sleep_calories_fit": (
            _fit("sleep_vs_calories", ["Id"], "Calories", "TotalMinutesAsleep"),
            ["Id", "Calories", "TotalMinutesAsleep", "Slope", "Intercept", "Fitted"],
            {"Calories", "TotalMinutesAsleep"} | fit_doubles,
        ),
        "heartrate_calories": (
            "SELECT * FROM heartrate_calories",
            ["Id", "Day", "Calories", "AvgHeartrate"],
            {"Calories", "AvgHeartrate"},
        ),
        "heartrate_fit_by_user": (
            f"""SELECT Id, {_slope('Calories', 'AvgHeartrate')} AS Slope,
                 {_intercept('Calories', 'AvgHeartrate')} AS Intercept,
                 CAST(regr_count(Calories, AvgHeartrate) AS BIGINT) AS N
               FROM heartrate_calories GROUP BY Id""",
            ["Id", "Slope", "Intercept", "N"],
            {"Slope", "Intercept"},
        ),
        "sample_users": ("SELECT * FROM sample_users", ["Id", "SampleRank"], set()),
        "sample_user_days": (
            "SELECT * FROM sample_user_days",
            ["Id", "Day", "Calories", "AvgHeartrate", "SampleRank"],
            {"Calories", "AvgHeartrate"},
        ),
        "sample_user_fits": (
            f"""SELECT Id, SampleRank, {_slope('Calories', 'AvgHeartrate')} AS Slope,
                 {_intercept('Calories', 'AvgHeartrate')} AS Intercept,
                 CAST(regr_count(Calories, AvgHeartrate) AS BIGINT) AS N
               FROM sample_user_days GROUP BY Id, SampleRank""",
            ["Id", "SampleRank", "Slope", "Intercept", "N"],
            {"Slope", "Intercept"},
        ),
        "sample_user_predictions": (
            f"""SELECT d.Id, d.Day, d.Calories, d.AvgHeartrate, d.SampleRank,
                 d.AvgHeartrate * m.Slope + m.Intercept AS FittedCalories
               FROM sample_user_days d
               LEFT JOIN (SELECT Id, {_slope('Calories', 'AvgHeartrate')} AS Slope,
                            {_intercept('Calories', 'AvgHeartrate')} AS Intercept
                          FROM sample_user_days GROUP BY Id) m ON d.Id = m.Id""",
            ["Id", "Day", "Calories", "AvgHeartrate", "SampleRank", "FittedCalories"],
            {"Calories", "AvgHeartrate", "FittedCalories"},
        ),
        "sample_user_drilldown": (
            f"""SELECT d.Id, d.Day, a.VeryActiveMinutes, a.FairlyActiveMinutes, a.LightlyActiveMinutes,
                 a.SedentaryMinutes, d.Calories
               FROM heartrate_calories d
               JOIN sample_users u ON d.Id = u.Id AND u.SampleRank = {p.drilldown_pick}
               JOIN daily_activity a ON d.Id = a.Id AND d.Day = a.ActivityDate""",
            ["Id", "Day", "VeryActiveMinutes", "FairlyActiveMinutes", "LightlyActiveMinutes",
             "SedentaryMinutes", "Calories"],
            {"Calories"},
        ),
        "csv_rejects": (
            """SELECT Id, SleepDay,
                 CASE WHEN bad = '' THEN CAST(m AS INTEGER) END AS TotalMinutesAsleep,
                 CASE WHEN bad = '' THEN CAST(b AS INTEGER) END AS TotalTimeInBed, nullif(bad, '') AS Reasons
               FROM (SELECT *, concat_ws('; ',
                   CASE WHEN m <> floor(m) THEN 'TotalMinutesAsleep: not int: ' || CAST(m AS VARCHAR) END,
                   CASE WHEN b <> floor(b) THEN 'TotalTimeInBed: not int: ' || CAST(b AS VARCHAR) END) AS bad
                 FROM (SELECT Id, SleepDay, CAST(TotalMinutesAsleep AS DECIMAL(18, 2)) AS m,
                     CAST(TotalTimeInBed AS DECIMAL(18, 2)) AS b FROM daily_sleep))""",
            ["Id", "SleepDay", "TotalMinutesAsleep", "TotalTimeInBed", "Reasons"],
            set(),
        ),
        "activity_day_forms": (
            """SELECT Form, Id, Date, TotalSteps, WeekDayN, SumOfDistances
               FROM activity_clean, (VALUES ('date'), ('slashes'), ('iso'), ('time')) AS forms(Form)""",
            ["Form", "Id", "Date", "TotalSteps", "WeekDayN", "SumOfDistances"],
            {"SumOfDistances"},
        ),
        "moment_fits": (
            " UNION ALL ".join(
                f"""SELECT '{level}' AS Level, {id_} AS Id, {day} AS Day, {_slope('Calories', 'AvgHeartrate')} AS Slope,
                 {_intercept('Calories', 'AvgHeartrate')} AS Intercept,
                 CAST(regr_count(Calories, AvgHeartrate) AS BIGINT) AS N
               FROM heartrate_calories {group}"""
                for level, id_, day, group in (
                    ("user", "Id", "CAST(NULL AS DATE)", "GROUP BY Id"),
                    ("day", "CAST(NULL AS BIGINT)", "Day", "GROUP BY Day"),
                    ("all", "CAST(NULL AS BIGINT)", "CAST(NULL AS DATE)", ""),
                )
            ),
            ["Level", "Id", "Day", "Slope", "Intercept", "N"],
            {"Slope", "Intercept"},
        ),
        "load_checks": (
            """SELECT CAST(sum(c) AS BIGINT) AS row_count,
                 CAST(coalesce(sum(c) FILTER (WHERE Id IS NULL), 0) AS BIGINT) AS Id_nulls,
                 CAST(coalesce(sum(c) FILTER (WHERE Date IS NULL), 0) AS BIGINT) AS Date_nulls,
                 CAST(coalesce(sum(c) FILTER (WHERE Time IS NULL), 0) AS BIGINT) AS Time_nulls,
                 CAST(coalesce(sum(c) FILTER (WHERE METs IS NULL), 0) AS BIGINT) AS METs_nulls,
                 CAST(count(*) FILTER (WHERE c > 1) AS BIGINT) AS duplicate_groups,
                 CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS duplicate_rows
               FROM (SELECT Id, Date, Time, METs, count(*) AS c FROM mets_clean GROUP BY Id, Date, Time, METs)""",
            ["row_count", "Id_nulls", "Date_nulls", "Time_nulls", "METs_nulls", "duplicate_groups", "duplicate_rows"],
            set(),
        ),
        "activity_positions": (
            "SELECT Id, Date, TotalSteps, row_number() OVER (ORDER BY Date, Id) AS Position FROM activity_clean",
            ["Id", "Date", "TotalSteps", "Position"],
            set(),
        ),
    }


# The plain-join forms of the two date-only joins answer to the same SQL.
SAME_AS = {
    "sleep_on_activity_days_join": "sleep_on_activity_days",
    "user_segments_join": "user_segments",
}


def oracle_sql(p: Params, m: EventMapping = EventMapping()) -> dict[str, str]:
    views = _views(m, p)
    out: dict[str, str] = {}
    for key, (body, cols, doubles) in _queries(p).items():
        out[key] = f"WITH {views}\n{_rounded(body, cols, doubles)}"
    for alias, key in SAME_AS.items():
        out[alias] = out[key]
    return out
