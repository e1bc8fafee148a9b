import os
import tempfile

from vitalspark.__main__ import main

from conftest import SF_SMALL
from test_sources import EXPORTS


def test_cli_over_an_event_log(spark):
    out = tempfile.mkdtemp(prefix="vitalspark-cli-")
    keys = "user_segments,duplicates,daily_trend"
    assert main(["--events", f"{SF_SMALL}/events.parquet", "--out", out, "--only", keys, "--ordered"]) == 0
    for key in keys.split(","):
        assert spark.read.parquet(os.path.join(out, key)).count() > 0
    dates = [r.Date for r in spark.read.parquet(os.path.join(out, "daily_trend")).collect()]
    assert len(dates) == 30


def test_cli_over_csv_tables(spark):
    folder = tempfile.mkdtemp(prefix="vitalspark-cli-csv-")
    for name, (header, lines, eol) in EXPORTS.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", newline="") as fh:
            fh.write(eol.join([header, *lines]) + eol)
    out = tempfile.mkdtemp(prefix="vitalspark-cli-out-")
    assert main(["--tables", folder, "--out", out]) == 0
    written = set(os.listdir(out))
    assert "sleep_vs_calories" in written and "duplicates" not in written  # needs an event log
    assert spark.read.parquet(os.path.join(out, "sleep_clean")).count() == 5


def test_cli_with_a_bucketed_rollup(spark):
    out = tempfile.mkdtemp(prefix="vitalspark-cli-bucket-")
    keys = "heartrate_calories,sleep_vs_calories,user_segments"
    args = ["--events", f"{SF_SMALL}/events.parquet", "--out", out, "--only", keys, "--rollup-table", "cli_test_rollup"]
    assert main(args) == 0
    for key in keys.split(","):
        assert spark.read.parquet(os.path.join(out, key)).count() > 0
    assert spark.catalog.tableExists("cli_test_rollup")
