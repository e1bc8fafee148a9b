"""Scalar helpers: row-wise sums, weekday columns and ANSI-safe parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspark.constants import DAY_FORMAT, WEEKDAY_NAME_FORMAT


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_columns(*cols) -> Column:
    """Row-wise ``a + b + ...`` with native semantics: NULL if any input is NULL."""
    if not cols:
        raise ValueError("sum_columns needs at least one column")
    return reduce(lambda a, b: a + b, [as_col(c) for c in cols])


def weekday_number(day) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(as_col(day))


def weekday_name(day) -> Column:
    """Short English weekday name, ``Sun`` ... ``Sat``."""
    return F.date_format(as_col(day), WEEKDAY_NAME_FORMAT)


def parse_date(c, fmt: str, strict: bool = True) -> Column:
    """Text -> date. ``strict=False`` yields NULL for unparsable text instead of
    failing the job (Spark 4 runs ANSI mode by default)."""
    c = as_col(c)
    return F.to_date(c, fmt) if strict else F.try_to_date(c, fmt)


def parse_timestamp(c, fmt: str, strict: bool = True) -> Column:
    """Text -> wall-clock timestamp (``timestamp_ntz``), independent of the
    session time zone, so no DST gap can move an hour."""
    c = as_col(c)
    parsed = F.to_timestamp_ntz(c, F.lit(fmt))
    if strict:
        return parsed
    # CASE evaluates the strict parse only where the lenient one succeeded.
    return F.when(F.try_to_timestamp(c, F.lit(fmt)).isNotNull(), parsed)


def split_part(c, sep: str, index: int, strict: bool = True) -> Column:
    """0-based part of ``split(c, sep)``; lenient form is NULL when missing."""
    parts = F.split(as_col(c), sep)
    return parts[index] if strict else F.get(parts, index)


# A day as text: M/d/yyyy or ISO, alone or before a time of day.
DAY_TEXT = (
    r"^\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})"
    r"(?:[ T]+[0-9:.]+(?: ?[AaPp][Mm])?(?:Z|[+-][0-9:]+)?)?\s*$"
)


def day_of_text(c, strict: bool = True) -> Column:
    """Day of a text in any of the forms that exports use: ``M/d/yyyy`` or ISO
    ``yyyy-MM-dd``, each alone or followed by a time of day. The form is told by
    the text itself, so a column may mix them and each row is parsed once. Text
    of no such form, or no real day, fails (``strict``) or is NULL."""
    text = as_col(c)
    day = F.regexp_extract(text, DAY_TEXT, 1)
    parsed = F.when(F.contains(day, F.lit("/")), F.try_to_date(day, DAY_FORMAT)).otherwise(F.try_to_date(day, "yyyy-M-d"))
    if not strict:
        return parsed
    bad = text.isNotNull() & parsed.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("not a day: "), text)).cast("date")).otherwise(parsed)


def to_day(c, fmt: str | None = None, strict: bool = True, dtype: T.DataType | None = None) -> Column:
    """Date column from a date, timestamp or text column. Text is read by
    :func:`day_of_text`, or in the one form ``fmt`` where it is given."""
    c = as_col(c)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return day_of_text(c, strict) if fmt is None else parse_date(c, fmt, strict)


def hour_of_text(c) -> Column:
    """Integer hour of an ``HH:mm`` text, read from the text itself (no
    detour through a timestamp on today's date)."""
    return F.substring_index(as_col(c), ":", 1).cast("int")


# Decimals kept when a double is snapped before rounding: enough to hold any
# tie exactly, few enough to absorb the float noise of sums and averages.
SNAP_DIGITS = 10


def round_half_up(c, digits: int = 0, snap_digits: int = SNAP_DIGITS) -> Column:
    """Round half away from zero as if computed exactly: the double is first
    snapped to ``snap_digits`` decimals (so 100.49999999999999 counts as the
    tie 100.5), then rounded as a decimal. Returns a double; values beyond the
    decimal's range (1e28 and more), NaN and infinities are returned as they are,
    as a double of that size has no decimals."""
    value = as_col(c)
    snapped = value.try_cast(T.DecimalType(38, snap_digits))
    return F.coalesce(F.round(snapped, digits).cast(T.DoubleType()), value.cast(T.DoubleType()))


# Decimals that an exact sum keeps of each value, and its digits before them.
EXACT_DIGITS, EXACT_WHOLE = 10, 12


def exact_sum(c, digits: int = EXACT_DIGITS) -> Column:
    """Sum (aggregate) of a numeric column as a decimal: each value counts as its
    shortest decimal text, kept to ``digits`` decimals, so the sum is exact and
    does not depend on the order of the rows. NULL if a value or the sum is beyond
    the decimal (1e12 for a value, 1e22 for the sum), NaN or infinite."""
    value = as_col(c).try_cast(T.DecimalType(EXACT_WHOLE + digits, digits))
    lost = F.count_if(as_col(c).isNotNull() & value.isNull())
    return F.when(lost == 0, F.try_sum(value))


def exact_avg(c, digits: int = EXACT_DIGITS) -> Column:
    """Average (aggregate) from the exact sum: the nearest double of it over the
    count. Where there is no exact sum it is the plain average."""
    c = as_col(c)
    exact = F.try_divide(exact_sum(c, digits).cast(T.DoubleType()), F.count(c).cast(T.DoubleType()))
    return F.coalesce(exact, F.avg(c))


def exact_rounded_avg(c, factor: int = 1, digits: int = EXACT_DIGITS) -> Column:
    """``factor`` times the average (aggregate), rounded half away from zero on
    the exact ratio ``factor * sum / n``: floor((2 factor |sum| + n) / 2 n) in
    decimals, so neither the sum nor the division can move a tie. Falls back to
    the rounded plain average where there is no exact sum."""
    c = as_col(c)
    total = exact_sum(c, digits).try_cast(T.DecimalType(18 + digits, digits))
    n = F.count(c).cast(T.DecimalType(18, 0))
    # decimal(18 + digits) times decimal(k, 0), doubled, plus n: within 38 digits
    scaled = F.abs(total) * F.lit(factor).cast(T.DecimalType(6, 0))
    fits = F.abs(F.avg(c)) * F.lit(float(factor)) < F.lit(9e18)  # a long holds it
    whole = F.when(fits, F.call_function("div", scaled + scaled + n, n + n))
    signed = F.when(total < 0, -whole).otherwise(whole).cast(T.DoubleType())
    return F.when(F.count(c) > 0, F.coalesce(signed, round_half_up(F.avg(c) * F.lit(factor))))


def round_doubles(df: DataFrame, digits: int) -> DataFrame:
    """Round every floating-point column (with :func:`round_half_up`); used to
    compare results against other engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_up(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
