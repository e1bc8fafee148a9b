"""Rows read from input files per registered analysis (via Spark's event log).

    python tests/scan_audit.py [sf_dir]

Prints, per analysis, the input rows read by all of its jobs (including the
side-table checkpoints) and that number over the event log's row count, i.e.
how many times the log is scanned. Every analysis should read each table it
uses once.
"""

import collections
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession
ev = tempfile.mkdtemp(prefix="audit-ev-")
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", ev)
         .config("spark.eventLog.compress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from vitalspark.plans.registry import run_analysis
from vitalspark.plans.analyses import ANALYSES
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
n_events = spark.read.parquet(f"{sf}/events.parquet").count()
for key in ANALYSES:
    spark.sparkContext.setJobGroup(key, key)
    run_analysis(spark, sf, key).write.format("noop").mode("overwrite").save()
spark.stop()
path = glob.glob(ev + "/*")[0]
files = sorted(glob.glob(path + "/events*")) if os.path.isdir(path) else [path]
job_group, stage_job = {}, {}
rows = collections.Counter()
for f in files:
    for line in open(f):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            g = e.get("Properties", {}).get("spark.jobGroup.id")
            for s in e["Stage IDs"]:
                stage_job[s] = g
        elif e["Event"] == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            rows[stage_job.get(e["Stage ID"])] += m.get("Input Metrics", {}).get("Records Read", 0)
for key in ANALYSES:
    print(f"{key:32s} input rows {rows[key]:>9d}  event-log scans {rows[key] / n_events:.2f}")
