"""Repeatable sampling of keys (users).

Keys are ranked by ``md5("<seed>:<key>")`` (ties by key), so the sample
depends only on the seed and the set of keys, not on partitioning, row order
or the engine. ``orderBy(...).limit(k)`` plans as a distributed top-k: every
task keeps its k best keys and one task merges ``k * tasks`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.constants import SAMPLE_SEED, SAMPLE_SIZE
from vitalspark.operators.sizing import bounded_broadcast, static_max_rows


def key_hash(key: str, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample_keys(
    df: DataFrame,
    key: str = "Id",
    k: int = SAMPLE_SIZE,
    seed: int = SAMPLE_SEED,
    rank_col: str = "SampleRank",
) -> DataFrame:
    """``k`` distinct non-NULL keys without replacement, with their draw order
    ``1..k``. Fewer than ``k`` distinct keys returns all of them."""
    if k < 1:
        raise ValueError("k must be positive")
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    top = keys.withColumn("_h", key_hash(key, seed)).orderBy("_h", key).limit(k)
    # The window runs over at most k rows (the limit above bounds it).
    return top.select(key, F.row_number().over(Window.orderBy("_h", key)).alias(rank_col))


def sample_rows(df: DataFrame, sampled: DataFrame, key: str = "Id") -> DataFrame:
    """Rows of ``df`` whose key was sampled, with the sample's columns added.

    A sample from :func:`sample_keys` has at most k rows, which its plan proves
    (the limit), so it is broadcast and ``df`` is filtered where it lies,
    without a shuffle. Any other ``sampled`` frame is measured first.
    """
    return df.join(bounded_broadcast(sampled), key, "inner")


def drawn_keys(sample: DataFrame, key: str = "Id", rank_col: str = "SampleRank") -> dict:
    """The sampled keys with their draw order, on the driver: at most k entries,
    which the sample's plan proves (its limit)."""
    if static_max_rows(sample) is None:
        raise ValueError("the sample's size is not bounded; draw it with sample_keys")
    return {r[key]: r[rank_col] for r in sample.select(key, rank_col).collect()}


def rows_of_keys(df: DataFrame, drawn: dict, key: str = "Id", rank_col: str = "SampleRank") -> DataFrame:
    """Rows of the drawn keys, with their draw order. The keys are literals of a
    filter, so Catalyst carries it below aggregations and joins on the key and
    into the file scan: what lies above reads these keys' rows only."""
    if not drawn:
        return df.where(F.lit(False)).withColumn(rank_col, F.lit(None).cast("int"))
    rank = F.create_map(*[F.lit(x) for pair in drawn.items() for x in pair])
    return df.where(F.col(key).isin(list(drawn))).withColumn(rank_col, F.element_at(rank, F.col(key)).cast("int"))


def sample_key_rows(
    df: DataFrame,
    key: str = "Id",
    k: int = SAMPLE_SIZE,
    seed: int = SAMPLE_SEED,
    rank_col: str = "SampleRank",
) -> DataFrame:
    """All rows of ``k`` sampled keys, with their draw order. Keys first: they are
    drawn from the key column alone, and then filter the rows at their source;
    nothing of ``df`` is stored in between."""
    drawn = drawn_keys(sample_keys(df.select(key), key, k, seed, rank_col), key, rank_col)
    return rows_of_keys(df, drawn, key, rank_col)
