"""Run the analyses over a set of tracker tables and write each result.

    python -m vitalspark --tables DIR [--format csv|parquet] --out OUT [--only a,b]
    python -m vitalspark --events PATH --out OUT [--steps-cut X --sleep-cut Y]

``--tables DIR`` holds one file or folder per table named ``<table>.<format>``
(``daily_activity.csv``, ``daily_sleep.csv``, ... see ``sources.SCHEMAS``); any of
the nine may be absent, and the analyses that need it are then skipped. Malformed
CSV records are counted on standard error and written to ``OUT/rejects``;
``--on-bad`` says whether their bad fields become NULL (default), the records are
left out or the run fails.
``--events PATH`` derives the tables from an event log (Parquet). Each analysis
is written to ``OUT/<name>`` as Parquet, in its presentation order when
``--ordered`` is given. On a cluster, submit this module's file with
``spark-submit`` (the package shipped with ``--py-files``); the session's
``spark.checkpoint.dir`` must then name a shared folder.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from vitalspark.plans.analyses import ANALYSES, NEEDS_EVENTS, Params, present
from vitalspark.sources import MissingTable, TrackerTables, read_tables, reject_counts, tracker_tables
from vitalspark.sources.event_log import read_events


ON_BAD = {"null": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}


def _tables(spark: SparkSession, args) -> TrackerTables:
    if args.events:
        folder, name = os.path.split(args.events.rstrip("/"))
        events = read_events(spark, folder or ".", name.removesuffix(".parquet"))
        # One checkpointed per user-day roll-up serves every daily analysis of
        # the run: the log is scanned once for all of them.
        return tracker_tables(events, share_daily=True, rollup_table=args.rollup_table)
    try:
        return read_tables(spark, args.tables, args.format, ON_BAD[args.on_bad])
    except FileNotFoundError as e:
        raise SystemExit(str(e)) from None


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="vitalspark", description=__doc__.split("\n")[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with one <table>.<format> per tracker table")
    src.add_argument("--events", help="event log (Parquet) to derive the tables from")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet", "orc", "json"])
    ap.add_argument("--on-bad", default="null", choices=sorted(ON_BAD), help="malformed CSV fields: NULL, record dropped, or failure")
    ap.add_argument("--out", required=True, help="output folder (one Parquet dataset per analysis)")
    ap.add_argument("--only", default="", help="comma-separated analyses (default: all)")
    ap.add_argument("--ordered", action="store_true", help="sort each result as originally presented")
    ap.add_argument(
        "--rollup-table",
        help="with --events: write the daily roll-up as this bucketed catalog table (shuffle-free (Id, day) joins)",
    )
    ap.add_argument("--lenient", action="store_true", help="unparsable dates/stamps become NULL instead of failing")
    ap.add_argument("--steps-cut", type=float, default=Params().steps_cut)
    ap.add_argument("--sleep-cut", type=float, default=Params().sleep_cut)
    args = ap.parse_args(argv)

    keys = [k for k in args.only.split(",") if k] or list(ANALYSES)
    unknown = [k for k in keys if k not in ANALYSES]
    if unknown:
        ap.error(f"unknown analyses {unknown}; known: {sorted(ANALYSES)}")

    spark = SparkSession.builder.appName("vitalspark").getOrCreate()
    tables = _tables(spark, args)
    params = Params(steps_cut=args.steps_cut, sleep_cut=args.sleep_cut, strict=not args.lenient)
    for key in keys:
        if key in NEEDS_EVENTS and tables.events is None:
            print(f"skip {key}: needs --events", file=sys.stderr)
            continue
        try:
            df = ANALYSES[key](tables, params)
        except MissingTable as e:
            print(f"skip {key}: {e}", file=sys.stderr)
            continue
        if args.ordered:
            df = present(key, df)
        df.write.mode("overwrite").parquet(os.path.join(args.out, key))
        print(f"wrote {key}", file=sys.stderr)
    if args.format == "csv" and tables.rejects is not None and args.on_bad != "fail":
        where = os.path.join(args.out, "rejects")
        tables.rejects.write.mode("overwrite").parquet(where)
        for r in reject_counts(spark.read.parquet(where)).orderBy("table", "file", "kind").toLocalIterator():
            print(f"rejected {r['records']} records of {r['table']} ({r['file']}): {r['kind']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
