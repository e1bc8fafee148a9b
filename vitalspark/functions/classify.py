"""Threshold classification as ``CASE WHEN`` chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspark.functions.columns import as_col


def bucketize(c, cuts: Sequence[float], labels: Sequence[str], null_label: str) -> Column:
    """Label ``c`` by right-closed intervals: ``(-inf, cuts[0]]``,
    ``(cuts[0], cuts[1]]``, ..., ``(cuts[-1], +inf)``.

    NULL gets ``null_label``; NaN compares above every number in Spark and so
    lands in the last bucket.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("need exactly one more label than cuts")
    if list(cuts) != sorted(cuts):
        raise ValueError("cuts must be ascending")
    c = as_col(c)
    expr = F.when(c <= cuts[0], labels[0])
    for lo, hi, label in zip(cuts, cuts[1:], labels[1:-1]):
        expr = expr.when((c > lo) & (c <= hi), label)
    expr = expr.when(c > cuts[-1], labels[-1])
    return expr.otherwise(null_label)


def quadrant(
    a,
    a_cut: float,
    b,
    b_cut: float,
    hi_hi: str,
    hi_lo: str,
    lo_hi: str,
    lo_lo: str,
    other: str,
) -> Column:
    """2 x 2 classification on two metrics (``>= cut`` is high); NULL in
    either metric gives ``other``."""
    a, b = as_col(a), as_col(b)
    return (
        F.when((a >= a_cut) & (b >= b_cut), hi_hi)
        .when((a >= a_cut) & (b < b_cut), hi_lo)
        .when((a < a_cut) & (b >= b_cut), lo_hi)
        .when((a < a_cut) & (b < b_cut), lo_lo)
        .otherwise(other)
    )
