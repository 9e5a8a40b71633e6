"""Evaluation operators: hit@k, accuracy, confusion, tie-aware top-1 and set grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_positions(hits: DataFrame) -> DataFrame:
    """q, doc, place: documents in the order of their best hit; hits has q, doc, rank."""
    best = hits.groupBy("q", "doc").agg(F.min("rank").alias("rank"))
    return best.select("q", "doc", F.row_number().over(Window.partitionBy("q").orderBy("rank", "doc")).alias("place"))


def hit_at(places: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """q, hit of every question of expected (q, doc): whether one of its documents is among the first k."""
    found = places.where(F.col("place") <= k).join(expected, ["q", "doc"], "left_semi").select("q").distinct().withColumn("found", F.lit(True))
    return expected.select("q").distinct().join(found, "q", "left").select("q", F.coalesce("found", F.lit(False)).alias("hit"))


def rate(graded: DataFrame, ok: str) -> DataFrame:
    """hits, total, percent (cut to a whole number)."""
    n = F.sum(F.col(ok).cast("long"))
    return graded.agg(n.alias("hits"), F.count("*").alias("total")).withColumn("percent", F.expr("case when total > 0 then hits * 100 div total end"))


def accuracy(graded: DataFrame, by: str) -> DataFrame:
    """hits and total of each class and, under a null class, of all; graded has by and ok."""
    return graded.rollup(by).agg(F.sum(F.col("ok").cast("long")).alias("hits"), F.count("*").alias("total"))


def grade_sets(got: DataFrame, expected: DataFrame) -> DataFrame:
    """q, grade: exact, over (all expected and more) or wrong; both have q, id."""
    both = expected.select("q", "id", F.lit(1).alias("e")).distinct().join(got.select("q", "id", F.lit(1).alias("g")).distinct(), ["q", "id"], "full_outer")
    n = both.groupBy("q").agg(F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"))
    return n.select("q", F.when(F.col("missing") > 0, "wrong").when(F.col("extra") > 0, "over").otherwise("exact").alias("grade"))


def envelope(df: DataFrame, most: int = 50) -> dict:
    """columns, rows, row_count, truncated of an answer; one row more than shown is fetched, so truncated is true to fact."""
    import datetime
    import decimal

    def plain(v):
        if isinstance(v, decimal.Decimal):
            return int(v) if v == v.to_integral_value() else float(v)
        return v.isoformat() if isinstance(v, datetime.date | datetime.time) else v

    rows = df.limit(most + 1).collect()
    shown = [[plain(v) for v in r] for r in rows[:most]]
    return {"columns": df.columns, "rows": shown, "row_count": len(shown), "truncated": len(rows) > most}
