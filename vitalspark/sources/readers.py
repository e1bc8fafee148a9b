"""Reading the tracker tables with declared schemas.

Text sources (CSV) are read as text once and cast natively to the declared
types, so a field that does not fit is known with its record: it is NULL in the
table (or its record is left out, or the read fails, as asked), and always a row
of the table's *rejects* with file, record and reason.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspark.functions.columns import day_of_text
from vitalspark.sources.schemas import REQUIRED, SCHEMAS

#: What happens to a malformed field: its NULL is kept, its record is left out,
#: or the read fails.
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
FORMATS = ("csv", "parquet", "orc", "json")
REJECT_SCHEMA = "table string, file string, record string, reasons array<string>"


@dataclass(frozen=True)
class TableRead:
    """A table and its malformed records ``(table, file, record, reasons)``."""

    rows: DataFrame
    rejects: DataFrame


def _free(columns: list[str], wanted: str) -> str:
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _typed(c: Column, dtype: T.DataType) -> Column:
    """The text as a value of the declared type, NULL where it is none."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.DateType):
        return day_of_text(c, strict=False)
    return F.trim(c).try_cast(dtype)


def _read_csv(spark: SparkSession, name: str, path: str, mode: str) -> TableRead:
    reader = spark.read.option("header", True).option("sep", ",")
    header = reader.csv(path).columns  # the header row only
    declared = {f.name.lower(): f.dataType for f in SCHEMAS[name].fields}
    kinds = {c: declared.get(c.lower(), T.StringType()) for c in header}
    raw = _free(header, "_record")
    text = T.StructType([*(T.StructField(c, T.StringType()) for c in header), T.StructField(raw, T.StringType())])
    base = (
        reader.schema(text)
        .option("enforceSchema", False)  # every file's header must agree
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", raw)  # set where fields are missing or too many
        .csv(path)
    )
    quoted = {c: F.col(f"`{c}`") for c in header}
    typed = {c: _typed(quoted[c], kinds[c]) for c in header}
    reasons = F.array_compact(
        F.array(
            F.when(F.col(raw).isNotNull(), F.lit(f"not {len(header)} fields")),
            *[
                F.when(quoted[c].isNotNull() & typed[c].isNull(), F.concat(F.lit(f"{c}: not {kinds[c].simpleString()}: "), quoted[c]))
                for c in header
                if not isinstance(kinds[c], T.StringType)
            ],
        )
    )
    record = F.coalesce(F.col(raw), F.to_csv(F.struct(*[quoted[c] for c in header])))
    bad = F.size(reasons) > 0
    rejects = base.where(bad).select(
        F.lit(name).alias("table"), F.col("_metadata.file_path").alias("file"), record.alias("record"), reasons.alias("reasons")
    )
    if mode == "FAILFAST":
        fail = F.raise_error(F.concat(F.lit(f"{name}: "), F.array_join(reasons, "; "), F.lit(" in "), record))
        base = base.where(F.when(bad, fail.cast("boolean")).otherwise(F.lit(True)))
    elif mode == "DROPMALFORMED":
        base = base.where(~bad)
    return TableRead(base.select(*[typed[c].alias(c) for c in header]), rejects)


def load_table(spark: SparkSession, name: str, path: str, fmt: str = "csv", mode: str = "PERMISSIVE") -> TableRead:
    """Read one of the nine tables, with its malformed records.

    ``fmt="csv"`` binds the declared types to the header's columns by name (comma
    separator, no inference pass; columns not declared are text). In ``mode``
    ``PERMISSIVE`` a malformed field is NULL, ``DROPMALFORMED`` leaves its record
    out, ``FAILFAST`` raises; the rejects list it in the first two. Parquet, ORC
    and JSON carry their own schema and have no rejects; the required columns are
    checked either way, so a missing column fails at plan time.
    """
    if name not in SCHEMAS:
        raise KeyError(f"unknown table {name!r}; known: {sorted(SCHEMAS)}")
    if mode.upper() not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    if fmt == "csv":
        read = _read_csv(spark, name, path, mode.upper())
    elif fmt in FORMATS:
        read = TableRead(spark.read.format(fmt).load(path), spark.createDataFrame([], REJECT_SCHEMA))
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    missing = [c for c in REQUIRED[name] if c not in read.rows.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return read


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "csv", mode: str = "PERMISSIVE") -> DataFrame:
    """The rows of :func:`load_table`."""
    return load_table(spark, name, path, fmt, mode).rows


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Malformed records per table, file and kind of reason (its column, or the
    number of fields)."""
    kind = F.regexp_extract("reason", r"^([^:]*)", 1)
    each = rejects.select("table", "file", F.explode("reasons").alias("reason"))
    return each.groupBy("table", "file", kind.alias("kind")).agg(F.count(F.lit(1)).alias("records"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_tables(spark: SparkSession, folder: str, fmt: str = "csv", mode: str = "PERMISSIVE"):
    """The tables that are in ``<folder>/<table>.<fmt>`` as :class:`TrackerTables`;
    any of the nine may be absent, all of them may not. The store is asked by
    Spark's own file access, so ``folder`` may be on any of its file systems."""
    from vitalspark.sources.event_log import TrackerTables

    paths = {name: f"{folder.rstrip('/')}/{name}.{fmt}" for name in SCHEMAS}
    found = {name: path for name, path in paths.items() if _exists(spark, path)}
    if not found:
        raise FileNotFoundError(f"none of the tables is in {folder}: {sorted(paths.values())}")
    reads = {name: load_table(spark, name, path, fmt, mode) for name, path in found.items()}
    rejects = reduce(DataFrame.unionByName, (r.rejects for r in reads.values()))
    return TrackerTables(rejects=rejects, **{name: r.rows for name, r in reads.items()})
