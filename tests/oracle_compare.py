"""Run queries() and oracle_sql() side by side and compare the results.

Usable as a script: ``python tests/oracle_compare.py [sf_dir] [key ...]``.
Comparison: same column names, same row count, and the same multiset of rows
after normalising values (dates -> ISO text, floats -> 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    return v


def _rows(records, cols):
    return sorted(
        (tuple(_norm(r[c]) for c in cols) for r in records),
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )


def compare(spark, sf_dir: str, key: str, query, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    spark_rows = [r.asDict() for r in sdf.collect()]
    spark_cols = sorted(sdf.columns)
    t1 = time.time()
    out = {"key": key, "spark_rows": len(spark_rows), "spark_sec": round(t1 - t0, 3)}
    if sql is None:
        out["status"] = "no-oracle"
        return out
    con = con or duck_connection(sf_dir)
    rel = con.sql(sql)
    duck_cols = sorted(rel.columns)
    duck_records = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    out["duck_rows"] = len(duck_records)
    if spark_cols != duck_cols:
        out["status"] = f"columns differ: spark={spark_cols} duck={duck_cols}"
        return out
    a, b = _rows(spark_rows, spark_cols), _rows(duck_records, spark_cols)
    if len(a) != len(b):
        out["status"] = "row count differs"
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["status"] = f"values differ, e.g. {diff}"
    else:
        out["status"] = "match"
    return out


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    # Session settings can be varied to check that results do not depend on
    # them: CHECK_TZ (session time zone), CHECK_PARTITIONS, CHECK_ANSI.
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("CHECK_PARTITIONS", "8"))
        .config("spark.ui.enabled", "false")
    )
    if os.environ.get("CHECK_TZ"):
        builder = builder.config("spark.sql.session.timeZone", os.environ["CHECK_TZ"])
    if os.environ.get("CHECK_ANSI"):
        builder = builder.config("spark.sql.ansi.enabled", os.environ["CHECK_ANSI"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck_connection(sf_dir)
    bad = 0
    for key in keys or list(qs):
        try:
            res = compare(spark, sf_dir, key, qs[key], sqls.get(key), con)
        except Exception as e:  # report and continue with the next key
            res = {"key": key, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        bad += res["status"] not in ("match", "no-oracle")
        print(res, flush=True)
    print(f"{len(keys or qs) - bad} ok, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
