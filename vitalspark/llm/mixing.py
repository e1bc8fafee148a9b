"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks. A source of weight w (its share of
all weights) has its i-th block released at slot floor(i / w) and due by ceil((i +
1) / w). Among the released blocks the earliest deadline goes first, so at every
slot each source has had within one block of w times the slots so far.

Weights are exact fractions: numbers as they are written, in lowest common terms.
With integer weights of sum C the schedule repeats after C slots, so one cycle is
computed, and every document finds its slot by arithmetic and a join with that
cycle. A cycle longer than ``MAX_SLOTS`` is refused with an error that names the
length; weights are never rounded or raised for it. When a source has run out its
slots stay empty and the others keep their proportions; no document is dropped or
repeated.

Documents of a source are numbered in an order by hash, inside small buckets
whose counts are summed first, so a source of any size is spread over tasks.

The pipeline mixes to ``TARGETS``. A table written in the mixed order loses it
when it is read in several tasks, so the pipeline's last stage finds (slot,
place) again, by the same arithmetic, and adds them as columns.

Defined cases: a null source is a source of its own; weights of absent sources
are ignored and sources without a weight get ``other``; without that their target
is the whole root of their size, in units large enough for the cycle (one at
least). A weight must be above 0. Equal and null ids are told apart by a hash of
the row, in their bucket too (rows equal in every column share one bucket); extra
columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspark.llm.common import table

#: The pipeline's target weights: equal shares of the twenty sources, and OTHER
#: for any source beside them, one without a name included.
TARGETS, OTHER = {f"src{i}": 1.0 for i in range(20)}, 1.0
BLOCK_DOCS, BUCKET_ROWS, MAX_SOURCES = 100, 500, 100_000
#: Slots of the longest cycle: rows of the schedule's table (three numbers each).
MAX_SLOTS = 1_000_000


def cycle(weights: dict) -> dict:
    """The weights as the smallest whole numbers in the same proportions: blocks
    of a source in a cycle of as many slots as their sum."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("target weights are above 0")
    if not exact:
        return {}
    whole = math.lcm(*(w.denominator for w in exact.values()))
    counts = {s: int(w * whole) for s, w in exact.items()}
    common = math.gcd(*counts.values())
    counts = {s: n // common for s, n in counts.items()}
    if (slots := sum(counts.values())) > MAX_SLOTS:
        raise ValueError(f"these weights repeat after {slots} slots only, above {MAX_SLOTS}; give rounder weights")
    return counts


def size_targets(sizes: dict) -> dict:
    """Targets by size: the whole root of a source's rows, in units of as many as
    let the cycle end within MAX_SLOTS."""
    roots = {s: max(1, math.isqrt(n)) for s, n in sizes.items()}
    unit = -(-2 * sum(roots.values()) // MAX_SLOTS)
    return {s: max(1, r // unit) for s, r in roots.items()}


def schedule(counts: dict) -> list[tuple]:
    """(source, block of the cycle, slot), earliest deadline first among the
    released blocks; ties by the source's name."""
    slots = sum(counts.values())
    name = lambda s: (s is None, s or "")
    waiting = [(0, name(s), s, 0) for s in counts]
    heapq.heapify(waiting)
    ready, out = [], []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * slots // counts[s]), name(s), s, i))
        _, _, s, i = heapq.heappop(ready)
        out.append((s, i, slot))
        if i + 1 < counts[s]:
            heapq.heappush(waiting, ((i + 1) * slots // counts[s], name(s), s, i + 1))
    return out


def mix(docs: DataFrame, weights: dict | None = None, key: str = "doc_id", source: str = "source",
        block_docs: int = BLOCK_DOCS, other: float | None = None) -> DataFrame:
    """Add ``block`` (of its source), ``slot`` and ``place`` (in its block);
    (slot, place) is the mixed order."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("block", "slot", "place")]
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"),
        F.col(f"`{source}`").alias("src"),
        F.xxhash64(F.col(f"`{key}`"), F.lit("mix")).alias("h"),
        F.col(f"`{key}`").alias("id"),
        F.xxhash64(*[F.col(f"`{c}`") for c in kept if not isinstance(docs.schema[c].dataType, T.MapType)]).alias("of_row"),
    )
    sizes = df.groupBy("src").count().limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_size = size_targets({r["src"]: r["count"] for r in sizes})
    rest = lambda src: by_size[src] if other is None else other
    counts = cycle({r["src"]: (weights or {}).get(r["src"], rest(r["src"])) for r in sizes})
    kind = docs.schema[source].dataType.simpleString()
    number = {src: i for i, src in enumerate(counts)}
    per = spark.createDataFrame([(src, number[src], n) for src, n in counts.items()], f"s {kind}, si int, n int")
    slots = [(number[src], j, at) for src, j, at in schedule(counts)]
    columns = [pa.array(c, pa.int32()) for c in zip(*slots)] if slots else [pa.array([], pa.int32())] * 3
    plan = spark.createDataFrame(pa.Table.from_arrays(columns, names=["sj", "j", "at"]))
    buckets = max(1, max((r["count"] for r in sizes), default=0) // BUCKET_ROWS)

    df = df.withColumn("bucket", F.pmod(F.xxhash64("h", "of_row"), F.lit(buckets)))
    # one row a source and bucket
    earlier = Window.partitionBy("s1").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(F.col("src").alias("s1"), F.col("bucket").alias("b"))
        .count()
        .select("s1", "b", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("src", "bucket").orderBy("h", "id", "of_row")
    df = df.withColumn("row", F.row_number().over(inside) - 1)
    df = df.join(offsets, F.col("src").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b")))
    rank = F.col("row") + F.col("before")
    df = df.withColumn("block", F.floor(rank / block_docs).cast("long")).withColumn(
        "place", F.pmod(rank, F.lit(block_docs)).cast("int")
    )
    # these have at most MAX_SOURCES and MAX_SLOTS rows
    df = df.join(F.broadcast(per), F.col("src").eqNullSafe(F.col("s")))
    df = df.join(F.broadcast(plan), (F.col("si") == F.col("sj")) & (F.pmod("block", "n") == F.col("j")))
    slot = F.floor(F.col("block") / F.col("n")).cast("long") * sum(counts.values()) + F.col("at")
    return df.select("doc.*", "block", slot.alias("slot"), "place")


def mixing_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the text's hash tells rows of null or equal ids apart
    thin = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return mix(thin, TARGETS, other=OTHER).drop("text_hash")


def targeted(docs: DataFrame) -> DataFrame:
    """``docs`` with block, slot and place under the pipeline's targets."""
    return mix(docs, TARGETS, other=OTHER)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mixed order. The texts move twice: to be numbered within
    their bucket and in the sort."""
    return targeted(docs).orderBy("slot", "place").select(docs.columns)
