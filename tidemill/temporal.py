"""As-of and interval joins.

as_of() gives each row of the left side the last row of the right side at or before its time, within a key. Time is cut into
slices of a fixed width. The last right row of each key and slice is taken first, with partial sums before the shuffle; a
window over these few rows carries it forward to the slices after; and the join itself is a window within one key and slice,
which merges both sides in order of time. So a hot key is many small groups and not one, as long as slices are narrow
beside the time it spans: no task sorts all rows of a key, only its slices.

interval_join() pairs points with the intervals that hold them. An interval is repeated once for each slice it touches, a
point lies in one slice, so the join is on key and slice, is rechecked exactly and makes no pair twice.

Rows whose key or time is null match nothing; as_of keeps them on the left side. Of right rows at one time the largest by
their values, in the order given, is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slice(time: Column, seconds: int) -> Column:
    """The number of the slice a timestamp lies in."""
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, values: list[str], seconds: int = 86_400) -> DataFrame:
    """left with right_time and values of the last row of right (key, right_time, values) at or before its time; null where
    there is none. key has one name on both sides. seconds: the width of a slice, which changes the work and no result."""
    chosen = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_key"), F.struct(F.col(right_time).alias("_time"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(values)]).alias("_last"))
    chosen = chosen.withColumn("_slice", _slice(F.col("_last._time"), seconds))
    last = chosen.groupBy("_key", "_slice").agg(F.max("_last").alias("_last"))
    # Where a slice of the left side begins, the last row of all slices before it holds.
    asked = left.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), _slice(F.col(time), seconds).alias("_slice")).distinct()
    known = last.unionByName(asked.select("_key", "_slice", F.lit(None).cast(last.schema["_last"].dataType).alias("_last"))).groupBy("_key", "_slice").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select("_key", "_slice", F.last("_last", ignorenulls=True).over(before).alias("_last")).where("_last is not null")
    marks = chosen.unionByName(carried).select("_key", "_slice", "_last", F.col("_last._time").alias("_at"), F.lit(0).alias("_side"))
    row = F.struct(*[F.col(c) for c in left.columns])
    rows = left.select(F.col(key).alias("_key"), _slice(F.col(time), seconds).alias("_slice"), F.lit(None).cast(last.schema["_last"].dataType).alias("_last"), F.col(time).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"))
    whole = rows.where("_key is not null and _at is not null")
    both = marks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(whole)
    # Marks come before rows of their time; of marks at one time the largest is last.
    merged = Window.partitionBy("_key", "_slice").orderBy("_at", "_side", "_last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last("_last", ignorenulls=True).over(merged)).where("_side = 1").select("_row", "_last")
    found = found.unionByName(rows.where("_key is null or _at is null").select("_row", "_last"))
    return found.select("_row.*", F.col("_last._time").alias(right_time), *[F.col(f"_last._{i}").alias(c) for i, c in enumerate(values)])


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, seconds: int = 86_400) -> DataFrame:
    """Each of points (keys, time) with each of intervals (keys, start, end) where start <= time < end.

    seconds: the width of a slice; an interval is repeated for as many slices as it touches. No other column has one name on
    both sides.
    """
    held = intervals.where(F.col(start) < F.col(end))
    held = held.withColumn("_slice", F.explode(F.sequence(_slice(F.col(start), seconds), _slice(F.col(end) - F.expr("interval 1 microsecond"), seconds))))
    asked = points.where(F.col(time).isNotNull()).withColumn("_slice", _slice(F.col(time), seconds))
    fits = reduce(Column.__and__, [F.col(start) <= F.col(time), F.col(time) < F.col(end)])
    return asked.join(held, [*keys, "_slice"]).where(fits).drop("_slice")
