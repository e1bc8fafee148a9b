"""Compare the date-only fan-out queries with their oracle without collecting
the rows: both sides are reduced to (Date, TotalMinutesAsleep) -> count.

    python tests/fanout_multiset_check.py [sf_dir]
"""

import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as e
from oracle_compare import duck_connection
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
con = duck_connection(sf)
sql = e.oracle_sql()["sleep_on_activity_days"]
duck = {(str(d), m): n for d, m, n in con.sql(f"SELECT Date, TotalMinutesAsleep, count(*) FROM ({sql}) GROUP BY ALL").fetchall()}
for key in ("sleep_on_activity_days", "sleep_on_activity_days_join"):
    df = e.queries()[key](spark, sf)
    got = {(str(r[0]), r[1]): r[2] for r in df.groupBy("Date", "TotalMinutesAsleep").count().collect()}
    print(key, "rows", sum(got.values()), "vs", sum(duck.values()), "multiset equal:", got == duck)
