import datetime as dt
import random

import pytest

from vitalspark.operators import (
    drilldown,
    heartrate_calories,
    salted_join,
    sleep_on_activity_days,
    sleep_on_activity_days_join,
    sleep_vs_calories,
    user_segments,
    user_segments_join,
)
from vitalspark.sources.schemas import DAILY_ACTIVITY

from conftest import rows

D = [dt.date(2016, 4, 12) + dt.timedelta(days=i) for i in range(5)]


@pytest.fixture(scope="module")
def frames(spark):
    rnd = random.Random(7)
    act, slp = [], []
    for user in range(1, 25):
        for d in D:
            if rnd.random() < 0.8:
                steps = None if rnd.random() < 0.05 else rnd.randint(0, 20000)
                act.append((user, d, steps, float(rnd.randint(1000, 3000))))
            if rnd.random() < 0.5:
                asleep = None if rnd.random() < 0.05 else float(rnd.randint(60, 700))
                slp.append((user, d, asleep, 500.0))
    # a hot day, a day only in activity, a NULL date, and an exact duplicate sleep row
    act += [(99, D[0], 12000, 2500.0), (98, dt.date(2016, 5, 1), 1, 1.0), (97, None, 5, 5.0)]
    slp += [(99, D[0], 430.0, 450.0), (99, D[0], 430.0, 450.0), (96, None, 300.0, 310.0)]
    a = spark.createDataFrame(act, "Id long, Date date, TotalSteps int, Calories double")
    s = spark.createDataFrame(slp, "Id long, Date date, TotalMinutesAsleep double, TotalTimeInBed double")
    return a, s


def test_fanout_equals_plain_join(frames):
    a, s = frames
    expected = rows(sleep_on_activity_days_join(a, s))
    assert rows(sleep_on_activity_days(a, s)) == expected
    # several chunks per day, many tasks, few salts
    assert rows(sleep_on_activity_days(a, s, chunk=3)) == expected
    assert rows(sleep_on_activity_days(a, s, chunk=2, task_rows=7, salts=1)) == expected
    assert rows(sleep_on_activity_days(a.where("false"), s)) == rows(sleep_on_activity_days(a, s.where("false"))) == []


def _approx(rs, digits=9):
    return [tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rs]


def test_user_segments_preaggregated_equals_plain_join(frames):
    a, s = frames
    plain = _approx(rows(user_segments_join(a, s, 10000, 420)))
    assert _approx(rows(user_segments(a, s, 10000, 420))) == plain
    assert _approx(rows(user_segments(a, s, 10000, 420, salts=1))) == plain
    assert _approx(rows(user_segments(a, s, 10000, 420, salts=50))) == plain
    assert {r[3] for r in plain} <= {
        "More Active, More Sleep",
        "More Active, Less Sleep",
        "Less Active, More Sleep",
        "Less Active, Less Sleep",
        "Other",
    }


def test_user_segments_on_id_and_date(frames):
    a, s = frames
    out = user_segments(a, s, 10000, 420, on=("Id", "Date"))
    assert rows(out) == rows(user_segments_join(a, s, 10000, 420, on=("Id", "Date")))


def test_sleep_vs_calories_inner_join_drops_unmatched(spark):
    a = spark.createDataFrame(
        [(1, D[0], 100.0), (1, D[1], 200.0), (2, D[0], 50.0)], "Id long, Date date, Calories double"
    )
    s = spark.createDataFrame(
        [(1, D[0], 300.0, 320.0), (1, D[0], 300.0, 320.0), (3, D[0], 1.0, 1.0)],
        "Id long, Date date, TotalMinutesAsleep double, TotalTimeInBed double",
    )
    # the duplicate sleep row counts twice, as in a plain join
    assert rows(sleep_vs_calories(a, s)) == [(1, 600.0, 640.0, 200.0)]


def _raw_activity(spark, data):
    full = [
        (i, day, 10, 1.0, 1.0, 0.0, 0.5, 0.5, 0.0, 0.0, vam, fam, lam, sm, cal)
        for (i, day, vam, fam, lam, sm, cal) in data
    ]
    return spark.createDataFrame(full, DAILY_ACTIVITY)


def test_heartrate_calories_and_drilldown(spark):
    act = _raw_activity(
        spark,
        [(1, "4/12/2016", 1, 2, 3, 4, 2000), (1, "4/13/2016", 5, 6, 7, 8, 2100), (2, "4/12/2016", 0, 0, 0, 0, 0)],
    )
    hr = spark.createDataFrame(
        [(1, D[0], 70.5, 100), (2, D[0], 80.0, 50), (3, D[0], 60.0, 10)],
        "Id long, Day date, Mean_Value double, Entry_Count int",
    )
    hc = heartrate_calories(act, hr)
    assert hc.columns == ["Id", "Day", "Calories", "AvgHeartrate"]
    assert rows(hc) == [(1, D[0], 2000, 70.5), (2, D[0], 0, 80.0)]
    dd = drilldown(hc.where("Id = 1"), act)
    assert rows(dd) == [(1, D[0], 1, 2, 3, 4, 2000)]


@pytest.fixture
def nothing_broadcast(spark):
    """As for tables too large to broadcast, with as many tasks as partitions."""
    off = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    saved = {k: spark.conf.get(k, None) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows_per_task(df):
    from pyspark.sql import functions as F

    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def _hot_activity(spark, n=60_000):
    """One day has a third of all rows, 29 others the rest."""
    from pyspark.sql import functions as F

    day = F.expr("date_add(date'2021-03-01', cast(if(id % 3 = 0, 0, 1 + id % 29) as int))")
    return spark.range(n).select(F.col("id").alias("Id"), day.alias("Date"), (F.col("id") % 1000).cast("int").alias("TotalSteps"))


def test_a_hot_day_is_spread_without_broadcast(spark, nothing_broadcast):
    activity = _hot_activity(spark)
    per_day = activity.select("Date").distinct().selectExpr("Date", "1L as n")
    met = salted_join(activity, per_day, ["Date"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin [Date" in plan
    sizes = _rows_per_task(met)
    assert sum(sizes) == 60_000 and len(sizes) == 16
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    sleep = spark.createDataFrame([(i, D[0], 60.0 * i) for i in range(4)], "Id long, Date date, TotalMinutesAsleep double")
    segments = user_segments(activity, sleep)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in segments


def test_fanout_tasks_follow_the_output(spark, nothing_broadcast):
    from pyspark.sql import functions as F

    activity = _hot_activity(spark, 6_000).select("Id", "Date")
    sleep = _hot_activity(spark, 900).select("Id", "Date", (F.col("Id") * 1.5).alias("TotalMinutesAsleep"))
    expected = activity.groupBy("Date").count().join(sleep.groupBy("Date").count().withColumnRenamed("count", "k"), "Date")
    total = expected.selectExpr("sum(count * k)").head()[0]
    for task_rows in (50_000, 200_000):
        out = sleep_on_activity_days(activity, sleep, chunk=500, task_rows=task_rows)
        sizes = _rows_per_task(out)
        assert sum(sizes) == total
        assert out.rdd.getNumPartitions() == -(-total // task_rows)
        assert sizes[-1] <= 1.5 * task_rows  # the hot day takes many tasks
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_user_segments_join_makes_no_pairs_of_a_day(spark):
    activity = spark.range(4000).selectExpr("id AS Id", "date'2016-04-12' AS Date", "CAST(id % 7 AS int) AS TotalSteps")
    sleep = spark.range(4000).selectExpr("id AS Id", "date'2016-04-12' AS Date", "IF(id % 10 = 0, NULL, CAST(id % 9 AS double)) AS TotalMinutesAsleep")
    out = user_segments_join(activity, sleep, 3, 4)
    got = {r.Id: (r.AvgSteps, r.AvgMinutesAsleep) for r in out.collect()}
    asleep = [i % 9 for i in range(4000) if i % 10]
    assert got == {i: (i % 7, sum(asleep) / len(asleep)) for i in range(4000)}
    made, nodes = [], [out._jdf.queryExecution().executedPlan().executedPlan()]
    while nodes:
        node = nodes.pop()
        if type_of(node).endswith("QueryStageExec"):
            nodes.append(node.plan())
        if "Join" in type_of(node):
            made.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
    assert made and max(made) <= 4000


def type_of(node) -> str:
    return node.getClass().getSimpleName()


def test_fanout_join_makes_its_copies_after_the_join(spark, frames):
    a, s = frames
    out = sleep_on_activity_days_join(a, s)
    assert rows(out) == rows(s.select("Date", "TotalMinutesAsleep").join(a.select("Date"), "Date"))
    day = "date'2016-04-12' AS Date"
    out = sleep_on_activity_days_join(spark.range(300).selectExpr(day), spark.range(200).selectExpr("id AS Id", day, "60D AS TotalMinutesAsleep"))
    assert {tuple(r) for r in out.distinct().collect()} == {(dt.date(2016, 4, 12), 60.0)}
    assert out.groupBy().count().head()[0] == 60_000
    out.collect()
    made, nodes = [], [out._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if "Join" in type_of(node):
            made.append(node.metrics().apply("numOutputRows").value())
        kids = [node.executedPlan()] if type_of(node).startswith("AdaptiveSparkPlan") else [node.plan()] if type_of(node).endswith("QueryStageExec") else []
        nodes += kids + [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= 200


def test_equal_rows_of_a_fanout_go_to_several_tasks(spark, nothing_broadcast):
    from vitalspark.operators.joins import _copied

    parts = spark.range(2000).selectExpr("date'2016-04-12' AS Date", "60D AS TotalMinutesAsleep", "100L AS _copies")
    sizes = _rows_per_task(_copied(parts, task_rows=20_000))
    assert sum(sizes) == 200_000 and len(sizes) == 10 and sizes[-1] <= 30_000


@pytest.mark.parametrize("key", ["sleep_on_activity_days", "sleep_on_activity_days_join"])
def test_fanout_queries_round_sleep_rows_and_not_their_copies(spark, tmp_path, key):
    from vitalspark.functions.columns import round_doubles
    from vitalspark.plans.registry import queries, run_analysis

    events = [
        (i, dt.datetime(2024, 1, 1 + i % 2, i % 24), i % 7, ["view", "purchase", "signup", "click", "error"][i % 5], i + 0.123456789, "{}")
        for i in range(200)
    ]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "events.parquet"))
    out = queries()[key](spark, str(tmp_path))
    plain = run_analysis(spark, str(tmp_path), key)
    assert rows(out) == rows(round_doubles(plain, 6)) != rows(plain) and out.schema == round_doubles(plain, 6).schema
    assert "round(" not in out._jdf.queryExecution().executedPlan().toString()
