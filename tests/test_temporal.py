"""As-of and interval joins against plain loops."""

import datetime
import random
import re

import pytest
from tidemill import temporal

T0 = datetime.datetime(2024, 3, 1)


def at(s):
    return None if s is None else T0 + datetime.timedelta(seconds=s)


def frames(spark):
    rng = random.Random(6)
    when = lambda: rng.choice([None, rng.randrange(0, 4000) * 25, rng.randrange(0, 4000) * 25, 86_400, 86_399, 43_200])
    left = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), when()) for i in range(400)]
    right = [(rng.choice(["hot", "hot", "a", "c", None]), when(), rng.choice([None, 1, 2, 3]), f"v{i % 9}") for i in range(150)]
    return left, right


@pytest.mark.parametrize("seconds", [1, 3600, 86_400, 10**7])
def test_as_of(spark, seconds):
    left, right = frames(spark)
    l_ = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "i long, k string, t timestamp").selectExpr("*", "1 as _last")
    r_ = spark.createDataFrame([(k, at(t), a, b) for k, t, a, b in right], "k string, rt timestamp, a int, b string")
    got = {r.i: (r.rt, r.a, r.b) for r in temporal.as_of(l_, r_, "k", "t", "rt", ["a", "b"], seconds).collect()}
    order = lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])
    want = {}
    for i, k, t in left:
        fits = [(rt, a, b) for rk, rt, a, b in right if None not in (k, t, rt) and rk == k and rt <= t]
        best = max(fits, key=order, default=(None, None, None))
        want[i] = (at(best[0]), *best[1:])
    assert got == want and sum(x[0] is not None for x in want.values()) > 100


@pytest.mark.parametrize("seconds", [60, 86_400])
def test_intervals(spark, seconds):
    rng = random.Random(7)
    points = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(0, 90_000), 86_400])) for i in range(200)]
    held = [(j, rng.choice(["a", "b", None]), s, s + rng.choice([-5, 0, 1, 600, 40_000])) for j, s in enumerate([0, 86_400, 85_800, *(rng.randrange(0, 90_000) for _ in range(40))])] + [(99, "a", None, 5)]
    p = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "i long, k string, t timestamp")
    h = spark.createDataFrame([(j, k, at(s), at(e)) for j, k, s, e in held], "j long, k string, s timestamp, e timestamp")
    got = sorted((r.i, r.j) for r in temporal.interval_join(p, h, ["k"], "t", "s", "e", seconds).collect())
    want = sorted((i, j) for i, k, t in points for j, hk, s, e in held if None not in (k, t, s) and k == hk and s <= t < e)
    assert got == want and len(want) > 50


def test_empty(spark):
    p = spark.createDataFrame([(1, "a", T0)], "i long, k string, t timestamp")
    r = spark.createDataFrame([], "k string, rt timestamp, a int")
    assert [tuple(x)[3:] for x in temporal.as_of(p, r, "k", "t", "rt", ["a"]).collect()] == [(None, None)]
    assert temporal.as_of(p.limit(0), r, "k", "t", "rt", ["a"]).count() == 0


def test_a_hot_key_is_many_groups(spark):
    """Rows meet by key and slice; the window by key alone sees one row for each slice."""
    p = spark.range(10).selectExpr("id as i", "string(id % 2) as k", "timestamp'2024-01-01' + make_dt_interval(id) as t")
    plan = temporal.as_of(p, p.selectExpr("k", "t as rt", "i as a"), "k", "t", "rt", ["a"])._jdf.queryExecution().optimizedPlan().toString()
    specs = {re.sub(r"#\d+L?", "", x.split(" ASC")[0]) for x in plan.split("windowspecdefinition(")[1:]}
    assert specs == {"_key, _slice", "_key, _slice, _at"}  # the first is ordered by slice, the second by time
