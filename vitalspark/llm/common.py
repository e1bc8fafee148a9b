"""Helpers shared by the operators: tables, the shared folder, memo tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.operators.sizing import ensure_checkpoint_dir

#: A word is a run of anything but these; fixed by the queries' definitions.
WHITE = r"[\x20\x09-\x0D]+"
#: Rows handled together inside a task, so lists of pieces stay small.
CHUNK_ROWS = 256
#: Entries that a worker's memo of words may hold before it starts anew.
MEMO_ENTRIES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that :func:`shared_path` named, once their readers are done."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole_text(column: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text (native)."""
    return F.array_remove(F.split(text, WHITE), "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, made longer until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def set_aside(df: DataFrame, names) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns of any of ``names`` under free names, and the
    columns that give back the names of ``df``, in its order."""
    wanted = {n.lower() for n in names}
    held = [free_name(df, f"_own{i}") if c.lower() in wanted else c for i, c in enumerate(df.columns)]
    return df.toDF(*held), [F.col(f"`{h}`").alias(c) for h, c in zip(held, df.columns)]


def likely_least(df: DataFrame, hash_column: str, wanted: int, rows: int) -> DataFrame:
    """Rows of ``df`` whose hash is below a share of four times ``wanted`` of
    ``rows``, so that a sort for the ``wanted`` least hashes meets few more rows
    than that in all, instead of as many from every task."""
    share = 4 * wanted / max(rows, 1)
    return df if share >= 1 else df.where(F.col(hash_column) < int(2**64 * share) - 2**63)


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the text
    ``''``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def chunks(batch, rows: int = CHUNK_ROWS):
    """Slices of an Arrow batch of at most ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_bytes(texts):
    """(bytes of all texts of an Arrow array without nulls, where each text begins
    and the last ends), without a copy."""
    import numpy as np
    import pyarrow as pa

    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    size = at[-1] - at[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, at[0]) if size else np.zeros(0, np.uint8)
    return data, at - at[0]
