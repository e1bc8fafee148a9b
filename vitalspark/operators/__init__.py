"""DataFrame -> DataFrame operators."""

from vitalspark.operators.aggregate import (
    average_by,
    daily_trend,
    frequency,
    hour_of_day_average,
    hour_text_average,
    intensity_level,
    rounded_avg,
    share_of_total,
    sleep_weekday_average,
    totals_by,
    user_totals,
    weekday_average,
)
from vitalspark.operators.checks import CheckedTable, write_checked
from vitalspark.operators.clean import (
    activity_clean,
    add_weekday,
    distinct_users,
    hourly_split,
    intensities_clean,
    mets_clean,
    rename_columns,
    sleep_clean,
)
from vitalspark.operators.joins import (
    MINUTE_COLUMNS,
    drilldown,
    heartrate_calories,
    heartrate_calories_of_days,
    salted_join,
    sleep_on_activity_days,
    sleep_on_activity_days_join,
    sleep_vs_calories,
    sleep_vs_calories_of_days,
    user_segments,
    user_segments_join,
)
from vitalspark.operators.moments import fit_moments, merge_moments, middle, moment_table, repivot
from vitalspark.operators.numbering import dense_index
from vitalspark.operators.quality import duplicate_summary, duplicates, null_counts
from vitalspark.operators.regression import fit_and_predict, fit_line, predict_line
from vitalspark.operators.sampling import drawn_keys, rows_of_keys, sample_key_rows, sample_keys, sample_rows
from vitalspark.operators.sizing import (
    bounded_broadcast,
    checked_broadcast,
    ensure_checkpoint_dir,
    materialize,
    scratch_path,
    static_max_rows,
    write_bucketed,
)

__all__ = [
    "CheckedTable",
    "MINUTE_COLUMNS",
    "activity_clean",
    "add_weekday",
    "average_by",
    "bounded_broadcast",
    "checked_broadcast",
    "daily_trend",
    "dense_index",
    "distinct_users",
    "drawn_keys",
    "drilldown",
    "duplicate_summary",
    "duplicates",
    "ensure_checkpoint_dir",
    "fit_and_predict",
    "fit_line",
    "fit_moments",
    "frequency",
    "heartrate_calories",
    "heartrate_calories_of_days",
    "hour_of_day_average",
    "hour_text_average",
    "hourly_split",
    "intensities_clean",
    "intensity_level",
    "materialize",
    "merge_moments",
    "mets_clean",
    "middle",
    "moment_table",
    "null_counts",
    "predict_line",
    "rename_columns",
    "repivot",
    "rounded_avg",
    "rows_of_keys",
    "salted_join",
    "sample_key_rows",
    "sample_keys",
    "sample_rows",
    "scratch_path",
    "share_of_total",
    "sleep_clean",
    "sleep_on_activity_days",
    "sleep_on_activity_days_join",
    "sleep_vs_calories",
    "sleep_vs_calories_of_days",
    "sleep_weekday_average",
    "static_max_rows",
    "totals_by",
    "user_segments",
    "user_segments_join",
    "user_totals",
    "weekday_average",
    "write_bucketed",
    "write_checked",
]
