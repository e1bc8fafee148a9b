"""Column-level expressions. Everything here is a built-in Spark expression,
so it stays inside whole-stage codegen; nothing calls back into Python."""

from vitalspark.functions.columns import (
    as_col,
    day_of_text,
    exact_avg,
    exact_rounded_avg,
    exact_sum,
    hour_of_text,
    parse_date,
    parse_timestamp,
    round_doubles,
    round_half_up,
    split_part,
    sum_columns,
    to_day,
    weekday_name,
    weekday_number,
)
from vitalspark.functions.classify import bucketize, quadrant

__all__ = [
    "as_col",
    "bucketize",
    "day_of_text",
    "exact_avg",
    "exact_rounded_avg",
    "exact_sum",
    "hour_of_text",
    "parse_date",
    "parse_timestamp",
    "quadrant",
    "round_doubles",
    "round_half_up",
    "split_part",
    "sum_columns",
    "to_day",
    "weekday_name",
    "weekday_number",
]
