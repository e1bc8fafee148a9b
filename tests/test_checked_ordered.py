"""Tables checked while they are written, and tables whose order lasts."""

import glob
import json
import random

import pytest

from vitalspark.operators import duplicate_summary, null_counts, write_checked
from vitalspark.plans.analyses import ANALYSES, present
from vitalspark.plans.registry import EVENT_PARAMS
from vitalspark.sources import in_order, load_tracker_tables, manifest, read_ordered, write_ordered

from conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    data = [(rng.randint(1, 40) if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), rng.randint(0, 3)) for _ in range(900)]
    data += [(7, "hot", 1)] * 500  # more than a third of all rows are one row
    return spark.createDataFrame(data, "id int, k string, v int").repartition(6)


def test_checks_equal_their_own_scans(spark, table, tmp_path):
    plain = write_checked(table, str(tmp_path / "plain"))
    counts = null_counts(table).head().asDict()
    assert plain.row_count == counts["row_count"] and {f"{c}_nulls": n for c, n in plain.nulls.items()} == {k: v for k, v in counts.items() if k != "row_count"}
    assert plain.duplicate_rows is None and rows(plain.read(spark)) == rows(table)
    whole = write_checked(table, str(tmp_path / "copies"), copies="n")
    expected = duplicate_summary(table, table.columns).head()
    assert (whole.duplicate_groups, whole.duplicate_rows) == tuple(expected)
    again = whole.read(spark).selectExpr("*", "explode(sequence(1L, n)) as c").drop("n", "c")
    assert rows(again) == rows(table)  # no row is forgotten
    keyed = write_checked(table, str(tmp_path / "keys"), keys=["id"], copies="n")
    assert (keyed.duplicate_groups, keyed.duplicate_rows) == tuple(duplicate_summary(table, ["id"]).head())
    assert keyed.summary(spark).columns == ["row_count", "id_nulls", "k_nulls", "v_nulls", "duplicate_groups", "duplicate_rows"]


def test_checks_of_an_empty_table_and_bad_names(spark, table, tmp_path):
    empty = write_checked(table.where("false"), str(tmp_path / "empty"), copies="n")
    assert (empty.row_count, empty.duplicate_groups, empty.duplicate_rows) == (0, 0, 0) and set(empty.nulls.values()) == {0}
    # empty, but known only when it runs
    none = write_checked(spark.read.parquet(f"{SF_SMALL}/events.parquet").where("value < -1"), str(tmp_path / "none"), copies="n")
    assert (none.row_count, none.duplicate_groups, none.duplicate_rows) == (0, 0, 0) and set(none.nulls.values()) == {0}
    with pytest.raises(ValueError):
        write_checked(table, str(tmp_path / "x"), copies="v")
    with pytest.raises(ValueError):
        write_checked(table, str(tmp_path / "x"), keys=["id"])
    dotted = spark.createDataFrame([(1, None)], "`a.b` int, c int")
    assert write_checked(dotted, str(tmp_path / "dots"), copies="n").nulls == {"a.b": 0, "c": 1}


def _input_rows(folder):
    """Rows that tasks read, from the event log of one session."""
    total = 0
    for f in glob.glob(f"{folder}/**", recursive=True):
        try:
            lines = open(f).readlines()
        except (IsADirectoryError, UnicodeDecodeError):
            continue
        for line in lines:
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd":
                total += (e.get("Task Metrics") or {}).get("Input Metrics", {}).get("Records Read", 0)
    return total


def test_checks_read_their_source_once(tmp_path):
    """In a session of its own, whose event log counts the rows read."""
    import subprocess
    import sys

    log = tmp_path / "log"
    log.mkdir()
    code = f"""
import sys; sys.path.insert(0, {sys.path[0]!r} + "/.."); sys.path.insert(0, "/root/repo")
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
     .config("spark.eventLog.compress", "false").config("spark.eventLog.dir", "file://{log}").getOrCreate())
from vitalspark.operators import write_checked
got = write_checked(s.read.parquet("{SF_SMALL}/events.parquet"), "{tmp_path}/out", copies="n")
print("rows", got.row_count)
s.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "rows 1000" in out.stdout, out.stderr[-2000:]
    assert _input_rows(log) == 1000


@pytest.mark.parametrize("order", [["k", "v"], ["id"]])
def test_positions_and_order_survive(spark, table, tmp_path, order):
    path = str(tmp_path / "ordered")
    write_ordered(table, path, order, files=9)
    files = manifest(spark, path).collect()
    # the hot row is a third of all and one value of the hash: its file is large, the others are not lost
    assert len(files) >= 3 and sum(f["rows"] for f in files) == table.count()
    none_first = lambda vs: tuple((v is not None, v if v is not None else 0) for v in vs)
    key = lambda r: none_first(r[c] for c in order)
    for a, b in zip(files, files[1:]):
        assert none_first(a["last"]) <= none_first(b["first"]) and a["before"] + a["rows"] == b["before"]
    out = read_ordered(spark, path)
    got = sorted(out.collect(), key=lambda r: r["Position"])
    assert [r["Position"] for r in got] == list(range(1, len(got) + 1))
    assert [key(r) for r in got] == sorted(key(r) for r in table.collect())
    assert rows(out.drop("Position")) == rows(table)
    assert [tuple(r) for r in in_order(spark, path)] == [tuple(r)[:-1] for r in got]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # the manifest's only


def test_presented_analyses_keep_their_order(spark, tmp_path):
    clean = ANALYSES["activity_clean"](load_tracker_tables(spark, SF_SMALL), EVENT_PARAMS)
    write_ordered(clean, str(tmp_path / "a"), ["Date", "Id"], files=5)
    wanted = [(r["Date"], r["Id"]) for r in present("activity_clean", clean).collect()]
    assert [(r["Date"], r["Id"]) for r in in_order(spark, str(tmp_path / "a"))] == wanted
    assert manifest(spark, str(tmp_path / "a")).count() > 1


def test_ranges_open_their_files_only(spark, tmp_path):
    df = spark.range(1000).selectExpr("id div 10 as day", "id as Id")
    path = str(tmp_path / "r")
    write_ordered(df, path, ["day", "Id"], files=10)
    part = read_ordered(spark, path, lower={"day": 20}, upper={"day": 29})
    got = sorted(part.collect(), key=lambda r: r["Position"])
    assert [(r["Id"], r["Position"]) for r in got] == [(i, i + 1) for i in range(200, 300)]
    assert len(part.inputFiles()) <= 4  # two or three files and the manifest
    assert read_ordered(spark, path, lower={"day": 5000}).count() == 0
    assert read_ordered(spark, path, upper={"day": 0, "Id": 3}).count() == 4
    with pytest.raises(ValueError):
        read_ordered(spark, path, lower={"Id": 3})


def test_an_empty_table_in_order(spark, table, tmp_path):
    write_ordered(table.where("false"), str(tmp_path / "e"), ["id"])
    assert read_ordered(spark, str(tmp_path / "e")).count() == 0 and list(in_order(spark, str(tmp_path / "e"))) == []
