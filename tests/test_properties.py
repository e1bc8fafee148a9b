"""Property tests: the rewritten operators equal their plain definitions on
random inputs (NULLs, duplicate rows, hot days, tiny chunk sizes), and the
scalar classifications / rounding equal their Python definitions."""

import datetime as dt
import math
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vitalspark.operators import dense_index, share_of_total, sleep_on_activity_days, user_segments

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

ids = st.integers(min_value=1, max_value=6)
days = st.one_of(st.sampled_from(DAYS), st.none())
activity_rows = st.lists(st.tuples(ids, days, st.one_of(st.none(), st.integers(0, 30000))), max_size=40)
sleep_rows = st.lists(
    st.tuples(ids, days, st.one_of(st.none(), st.integers(0, 900).map(float))), max_size=40
)


def _frames(spark, act, slp):
    a = spark.createDataFrame(act, "Id long, Date date, TotalSteps int")
    s = spark.createDataFrame(slp, "Id long, Date date, TotalMinutesAsleep double")
    return a, s


@SETTINGS
@given(act=activity_rows, slp=sleep_rows, chunk=st.integers(1, 5))
def test_fanout_is_the_date_join(spark, act, slp, chunk):
    a, s = _frames(spark, act, slp)
    got = Counter(tuple(r) for r in sleep_on_activity_days(a, s, chunk=chunk).collect())
    n_act = Counter(d for _, d, _ in act if d is not None)
    want = Counter()
    for _, d, m in slp:
        if d is not None and n_act[d]:
            want[(d, m)] += n_act[d]
    assert got == want


def _plain_segments(act, slp, steps_cut, sleep_cut):
    by_day = defaultdict(list)
    for _, d, m in slp:
        if d is not None:
            by_day[d].append(m)
    sums = defaultdict(lambda: [0.0, 0, 0.0, 0])
    for i, d, steps in act:
        for m in by_day.get(d, []) if d is not None else []:
            acc = sums[i]
            if steps is not None:
                acc[0] += steps
                acc[1] += 1
            if m is not None:
                acc[2] += m
                acc[3] += 1
    out = {}
    for i, (ss, sn, ms, mn) in sums.items():
        avg_s = ss / sn if sn else None
        avg_m = ms / mn if mn else None
        if avg_s is None or avg_m is None:
            seg = "Other"
        else:
            seg = ("More" if avg_s >= steps_cut else "Less") + " Active, " + (
                "More" if avg_m >= sleep_cut else "Less"
            ) + " Sleep"
        out[i] = (avg_s, avg_m, seg)
    return out


@SETTINGS
@given(act=activity_rows, slp=sleep_rows)
def test_preaggregated_segments_are_the_plain_join(spark, act, slp):
    a, s = _frames(spark, act, slp)
    got = {r.Id: (r.AvgSteps, r.AvgMinutesAsleep, r.UserSegment) for r in user_segments(a, s, 10000, 420).collect()}
    want = _plain_segments(act, slp, 10000, 420)
    assert got.keys() == want.keys()
    for i, (gs, gm, gseg) in got.items():
        ws, wm, wseg = want[i]
        assert (gs is None) == (ws is None) and (gm is None) == (wm is None)
        assert gs is None or math.isclose(gs, ws, rel_tol=1e-12)
        assert gm is None or math.isclose(gm, wm, rel_tol=1e-12)
        assert gseg == wseg


@SETTINGS
@given(keys=st.lists(st.one_of(st.none(), st.integers(-50, 50)), max_size=60), parts=st.integers(1, 5))
def test_dense_index_is_dense_rank(spark, keys, parts):
    df = spark.createDataFrame([(k,) for k in keys], "Id long")
    rank = {k: n + 1 for n, k in enumerate(sorted({k for k in keys if k is not None}))}
    out = dense_index(df, "Id", "n", num_partitions=parts).collect()
    assert sorted((r.Id is None, r.Id or 0) for r in out) == sorted((k is None, k or 0) for k in keys)
    assert all(r.n == (rank[r.Id] if r.Id is not None else None) for r in out)


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.floats(0, 1000)), min_size=1, max_size=30))
def test_shares_sum_to_one(spark, rows):
    df = spark.createDataFrame(rows, "l string, m double")
    out = share_of_total(df, "l", "m").collect()
    total = sum(m for _, m in rows)
    if total > 0:
        assert math.isclose(sum(r.Share for r in out), 1.0, rel_tol=1e-9)
    else:
        assert all(r.Share is None or math.isnan(r.Share) for r in out)


def _bucket(x, cuts=(10, 16), labels=("Low", "Medium", "High"), null="n/d"):
    if x is None:
        return null
    if math.isnan(x):
        return labels[-1]  # NaN sorts above every number in Spark
    if x <= cuts[0]:
        return labels[0]
    if x <= cuts[1]:
        return labels[1]
    return labels[2]


@SETTINGS
@given(xs=st.lists(st.one_of(st.none(), st.floats(allow_infinity=True), st.sampled_from([10.0, 16.0])), max_size=40))
def test_bucketize_matches_definition(spark, xs):
    from vitalspark.functions import bucketize

    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = {r.i: r.b for r in df.select("i", bucketize("x", [10, 16], ["Low", "Medium", "High"], "n/d").alias("b")).collect()}
    assert got == {i: _bucket(x) for i, x in enumerate(xs)}


@SETTINGS
@given(pairs=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from([9999.0, 10000.0, 10001.0])),
                                st.one_of(st.none(), st.sampled_from([419.0, 420.0, 421.0]))), max_size=30))
def test_quadrant_matches_definition(spark, pairs):
    from vitalspark.functions import quadrant

    def want(a, b):
        if a is None or b is None:
            return "Other"
        return ("H" if a >= 10000 else "L") + ("H" if b >= 420 else "L")

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a double, b double")
    q = quadrant("a", 10000, "b", 420, "HH", "HL", "LH", "LL", "Other")
    assert {r.i: r.q for r in df.select("i", q.alias("q")).collect()} == {
        i: want(a, b) for i, (a, b) in enumerate(pairs)
    }


@SETTINGS
@given(vals=st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(0, 12)), min_size=1, max_size=40))
def test_round_half_up_is_exact_decimal_rounding(spark, vals):
    from decimal import ROUND_HALF_UP, Decimal

    from vitalspark.functions import round_half_up

    xs = [k / 2**e / 100 for k, e in vals]  # many exact decimal ties
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = {r.i: r.r for r in df.select("i", round_half_up("x", 6).alias("r")).collect()}
    for i, x in enumerate(xs):
        snapped = Decimal(repr(x)).quantize(Decimal("1e-10"), rounding=ROUND_HALF_UP)
        assert got[i] == float(snapped.quantize(Decimal("1e-6"), rounding=ROUND_HALF_UP)), x
