"""Tables whose order lasts: sorted files with a manifest of their ranges.

A sorted DataFrame loses its order once its files are read in several tasks.
``write_ordered`` sorts (by ranges, each file sorted inside) and stores, next to
the files, a manifest with one row a file: its place in the order, its first and
last keys, its rows and the rows before it. ``read_ordered`` gives every row its
position from the manifest and its place in its file, without a shuffle or a sort;
with bounds it opens only the files whose range meets them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "_manifest"  # readers skip names that begin with an underscore
FILES = "files"


def write_ordered(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """Write ``df`` sorted by ``order`` (ascending, NULLs first) and its manifest.

    Rows are dealt by ranges of the order's columns, then of a hash of the row, so
    a key with a third of the rows is cut over several files; inside a file rows
    follow the same order, and equal keys are ordered by that hash.
    """
    spark = df.sparkSession
    order = list(order)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in order]
    ranged = df.withColumn("_tie", tie).repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    ranged.drop("_tie").write.parquet(f"{path}/{FILES}")
    written = spark.read.parquet(f"{path}/{FILES}")
    at = F.col("_metadata.row_index")
    key = F.struct(*keys)
    # the written keys are read once: one row a file
    per_file = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min_by(key, at).alias("first"), F.max_by(key, at).alias("last"), F.count(F.lit(1)).alias("rows")
    )
    part = F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("long")  # part numbers follow the ranges
    line = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_file.select(
        F.row_number().over(Window.orderBy(part, "file")).alias("place"),
        "file",
        "first",
        "last",
        "rows",
        F.coalesce(F.sum("rows").over(line), F.lit(0)).alias("before"),
    )
    placed.coalesce(1).write.parquet(f"{path}/{MANIFEST}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, in order: place, file, first, last, rows, before."""
    return spark.read.parquet(f"{path}/{MANIFEST}").orderBy("place")


def _meets(files: DataFrame, lower: dict | None, upper: dict | None) -> DataFrame:
    """Files that may hold rows from ``lower`` to ``upper``, given as values of the
    order's first columns. Only whole prefixes are compared."""
    def bound(values: dict, side: str) -> tuple[Column, Column]:
        names = [f.name for f in files.schema[side].dataType.fields][: len(values)]
        if set(names) != set(values):
            raise ValueError(f"bounds are on the order's first columns: {names}")
        kinds = {f.name: f.dataType for f in files.schema[side].dataType.fields}
        return (
            F.struct(*[F.col(f"{side}.`{n}`").alias(n) for n in names]),
            F.struct(*[F.lit(values[n]).cast(kinds[n]).alias(n) for n in names]),
        )

    if lower:
        end, low = bound(lower, "last")
        files = files.where(end >= low)
    if upper:
        begin, high = bound(upper, "first")
        files = files.where(begin <= high)
    return files


def read_ordered(
    spark: SparkSession, path: str, lower: dict | None = None, upper: dict | None = None, position: str = "Position"
) -> DataFrame:
    """The rows with their 1-based position in the order, in ``position``. With
    ``lower`` / ``upper`` (inclusive, on the first columns of the order) files
    outside the range are not opened and rows outside it are left out; positions
    stay those of the whole table."""
    files = _meets(manifest(spark, path), lower, upper)
    if lower or upper:
        names = [r["file"] for r in files.select("file").toLocalIterator()]
        if not names:
            return read_ordered(spark, path, position=position).where(F.lit(False))
        rows = spark.read.parquet(*[f"{path}/{FILES}/{n}" for n in names])
    else:
        rows = spark.read.parquet(f"{path}/{FILES}")
    columns = rows.columns
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    of = files.select(F.col("file").alias("_file"), F.col("before").alias("_before"))
    out = placed.join(of, "_file").select(*[F.col(f"`{c}`") for c in columns], (F.col("_before") + F.col("_at") + 1).alias(position))
    for bounds, side in ((lower, "low"), (upper, "high")):
        if bounds:
            own = F.struct(*[F.col(f"`{n}`").alias(n) for n in bounds])
            to = F.struct(*[F.lit(v).cast(out.schema[n].dataType).alias(n) for n, v in bounds.items()])
            out = out.where(own >= to if side == "low" else own <= to)
    return out


def in_order(spark: SparkSession, path: str) -> Iterator[Row]:
    """All rows in order, file by file (at most one file's rows are held)."""
    for r in manifest(spark, path).select("file").collect():  # one row a file
        rows = spark.read.parquet(f"{path}/{FILES}/{r['file']}")
        one = rows.select("*", F.col("_metadata.row_index").alias("_at")).coalesce(1).sortWithinPartitions("_at")
        yield from one.drop("_at").toLocalIterator()
