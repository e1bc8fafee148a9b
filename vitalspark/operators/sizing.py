"""Materialisation and size checks.

* ``materialize``: reliable checkpoint into ``spark.checkpoint.dir`` (lineage
  cut: a lost executor re-reads the checkpoint instead of re-running scans).
* ``checked_broadcast``: a side table is broadcast only after its row count
  has been measured; above the bound it is returned as is, for a shuffle join
  (where AQE's skew handling splits hot keys). It is checkpointed first, so
  measuring it does not recompute the (possibly large) scan behind it.
* ``bounded_broadcast``: no measuring job when the plan itself proves the
  bound (a ``limit``).
* ``write_bucketed``: a table bucketed on join keys, for shuffle-free joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, not bytes: the side tables here are narrow (a key and a few numbers).
# A session can set its own bound with spark.vitalspark.maxBroadcastRows.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_ROWS_CONF = "spark.vitalspark.maxBroadcastRows"


def broadcast_row_bound(spark: SparkSession, max_rows: int | None = None) -> int:
    """The broadcast bound: the explicit argument, else the session setting,
    else the default."""
    if max_rows is not None:
        return max_rows
    configured = spark.conf.get(MAX_BROADCAST_ROWS_CONF, None)
    return int(configured) if configured else DEFAULT_MAX_BROADCAST_ROWS


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context in this process
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session without
    one gets a private temporary folder (as in tests). Under Spark Connect the
    server's configuration applies and None is returned."""
    sc = _context(spark)
    if sc is None:
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)")
    folder = tempfile.mkdtemp(prefix="vitalspark-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def default_parallelism(spark: SparkSession) -> int:
    """Cores available to a stage: the context's default parallelism, or the
    shuffle partition count where there is no local context."""
    sc = _context(spark)
    if sc is not None:
        return max(sc.defaultParallelism, 1)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (eager): writes ``df`` to the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``keys`` into
    ``<checkpoint dir>/tables/<table>`` and return it read back.

    Joins and aggregations on ``keys`` over the returned frame need no shuffle
    (each bucket is one partition). Bucketing requires a catalog table, so the
    caller names it; an existing table of that name is replaced.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to write bucketed tables")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.write.mode("overwrite")
        .bucketBy(n, *keys)
        .sortBy(*keys)
        .option("path", f"{root.rstrip('/')}/tables/{table}")
        .saveAsTable(table)
    )
    return spark.table(table)


def static_max_rows(df: DataFrame) -> int | None:
    """Upper bound on ``df``'s rows that the optimized plan proves (e.g. from a
    ``limit``), or None when the plan gives no bound."""
    try:
        bound = df._jdf.queryExecution().optimizedPlan().maxRows()
    except AttributeError:  # no JVM plan handle (e.g. Spark Connect): no proof
        return None
    return int(bound.get()) if bound.isDefined() else None


def bounded_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` when its plan proves at most ``max_rows`` rows (no job
    is run); otherwise measure it first with :func:`checked_broadcast`."""
    max_rows = broadcast_row_bound(df.sparkSession, max_rows)
    bound = static_max_rows(df)
    if bound is not None and bound <= max_rows:
        return F.broadcast(df)
    return checked_broadcast(df, max_rows)[0]


def checked_broadcast(df: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Return ``(side, broadcast?)``: ``side`` carries a broadcast hint only
    when its measured row count is at most ``max_rows`` (see
    :func:`broadcast_row_bound`)."""
    max_rows = broadcast_row_bound(df.sparkSession, max_rows)
    side = materialize(df)
    if side.count() <= max_rows:
        return F.broadcast(side), True
    return side, False
