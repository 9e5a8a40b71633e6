"""Window frames counted in groups of peers, and frames without the row itself, its ties or its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCLUDE = ("no others", "current row", "group", "ties")


def group_frame(df: DataFrame, partition: list[str], order: list[Column], value: str, before: int | None, after: int | None, exclude: str = "no others", prefix: str = "frame") -> DataFrame:
    """df with <prefix>_sum, <prefix>_count and <prefix>_avg of value over groups between before and after.

    A group is the rows of a partition with equal order values. before and after count groups, None is unbounded; they are
    0 or more, so the row's own group lies in the frame and can be taken off. Dense ranks are the places of the groups: the
    frame is a range of ranks, and what is excluded is subtracted. Rows are shuffled once, by the partition, and sorted
    twice; a partition is one task's work, as in any window.

    Edge cases: null values are not counted; a frame without values has sum and avg null, count 0. Null partition or order
    values are equal to each other. Sums of floats may differ from added ones in the last digits; where the excluded rows
    hold NaN or an infinity so does the result. Names of df that begin with _frame are an error.
    """
    if exclude not in EXCLUDE:
        raise ValueError(f"exclude is one of {EXCLUDE}")
    if min(before or 0, after or 0) < 0:
        raise ValueError("frames hold the row's own group")
    if any(c.startswith("_frame") for c in df.columns):
        raise ValueError("names that begin with _frame are taken")
    ranked = df.withColumn("_frame_rank", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))
    by = Window.partitionBy(*partition).orderBy("_frame_rank")
    frame = by.rangeBetween(Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after)
    peers = by.rangeBetween(0, 0)
    total, n = F.sum(value).over(frame), F.count(value).over(frame)
    zero = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    group = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    if exclude == "current row":
        total, n = total - zero[0], n - zero[1]
    elif exclude == "group":
        total, n = total - group[0], n - group[1]
    elif exclude == "ties":
        total, n = total - group[0] + zero[0], n - group[1] + zero[1]
    out = ranked.withColumn("_frame_sum", total).withColumn("_frame_n", n)
    some = F.when(F.col("_frame_n") > 0, F.col("_frame_sum"))
    out = out.withColumns({f"{prefix}_sum": some, f"{prefix}_count": F.col("_frame_n"), f"{prefix}_avg": some / F.col("_frame_n")})
    return out.drop("_frame_rank", "_frame_sum", "_frame_n")
