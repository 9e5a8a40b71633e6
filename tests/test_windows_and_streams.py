"""Frames of groups against plain loops; streamed sessions against those of the whole table, in pieces and with restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from tidemill import streaming, windows

T0 = datetime.datetime(2024, 5, 1)


@pytest.mark.parametrize("exclude", windows.EXCLUDE)
@pytest.mark.parametrize("before, after", [(1, 1), (0, 0), (None, 0), (2, None)])
def test_group_frames(spark, exclude, before, after):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, 1, 1, 2, 3, 5]), rng.choice([None, 1, 2, 7])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, p string, o int, v int").selectExpr("*", "1 as n")
    got = {r.i: (r.x_sum, r.x_count, r.x_avg) for r in windows.group_frame(df, ["p"], [F.col("o")], "v", before, after, exclude, "x").collect()}
    want = {}
    for i, p, o, _ in rows:
        places = sorted({x[2] for x in rows if x[1] == p}, key=lambda y: (y is not None, y))
        rank = {y: k for k, y in enumerate(places)}
        lo, hi = -1 if before is None else rank[o] - before, len(places) if after is None else rank[o] + after
        frame = [x for x in rows if x[1] == p and lo <= rank[x[2]] <= hi]
        out = {"no others": lambda x: False, "current row": lambda x: x[0] == i, "group": lambda x: x[2] == o, "ties": lambda x: x[2] == o and x[0] != i}[exclude]
        held = [x[3] for x in frame if not out(x) and x[3] is not None]
        want[i] = (sum(held), len(held), sum(held) / len(held)) if held else (None, 0, None)
    assert got == want


def test_frames_refuse(spark):
    df = spark.range(3).selectExpr("id", "id as v")
    for bad in ({"exclude": "all"}, {"before": -1}):
        with pytest.raises(ValueError):
            windows.group_frame(df, [], [F.col("id")], "v", **({"before": 1, "after": 1} | bad))
    with pytest.raises(ValueError):
        windows.group_frame(df.withColumn("_frame_n", F.lit(1)), [], [F.col("id")], "v", 1, 1)
    assert windows.group_frame(df.limit(0), ["id"], [F.col("id")], "v", 1, 1).count() == 0


def read(spark, path):
    rows = spark.read.schema("user long, start timestamp, last timestamp, n long").parquet(path).collect()
    return sorted((r.user is not None, r.user or 0, r.start, r.last, r.n) for r in rows)


def test_sessions_in_pieces(spark, tmp_path):
    """Shuffled rows within the delay, many files, the run ended and started again: the same sessions, none twice."""
    rng = random.Random(11)
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [(rng.choice([1, 2, 3, None]), at(rng.randrange(0, 400) * 450)) for _ in range(900)] + [(1, None), (9, at(0)), (9, at(1800)), (9, at(3601))]
    rows.sort(key=lambda r: (r[1] or T0) + datetime.timedelta(seconds=rng.randrange(0, 3000)))  # none is more than 3000 s late
    kinds = "user long, ts timestamp, n int"
    inside = tmp_path / "in"
    query = lambda: streaming.keep(streaming.sessions(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(inside)), "user", "ts", "30 minutes", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    for k in range(0, len(rows), 310):
        for part in (rows[k : k + 155], rows[k + 155 : k + 310]):
            spark.createDataFrame([(*r, 1) for r in part], kinds).coalesce(1).write.mode("append").parquet(str(inside))
        run = query()
        run.awaitTermination()
        assert streaming.late(run) == 0
    before = read(spark, str(tmp_path / "out"))
    query().awaitTermination()  # nothing new: nothing is given again
    whole = streaming.sessions(spark.createDataFrame(rows, "user long, ts timestamp"), "user", "ts", "30 minutes", "1 hour").collect()
    end = max(r[1] for r in rows if r[1]) - datetime.timedelta(hours=1, minutes=30)
    want = sorted((r.user is not None, r.user or 0, r.start, r.last, r.n) for r in whole if r["last"] < end)
    assert read(spark, str(tmp_path / "out")) == before == want and len(want) > 30
    assert [(r.start, r.n) for r in whole if r.user == 9] == [(at(0), 2), (at(3601), 1)] or [(r.start, r.n) for r in whole if r.user == 9] == [(at(3601), 1), (at(0), 2)]

    spark.createDataFrame([(7, at(5), 1), (1, at(10), 1)], kinds).coalesce(1).write.mode("append").parquet(str(inside))
    run = query()
    run.awaitTermination()
    assert streaming.late(run) == 2 and read(spark, str(tmp_path / "out")) == want


def test_no_events(spark):
    assert streaming.sessions(spark.createDataFrame([], "user long, ts timestamp"), "user", "ts", "30 minutes", "1 hour").count() == 0
