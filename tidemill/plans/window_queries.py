"""Lateral top-k, frames of groups with exclusions, and sessions of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import streaming, windows
from tidemill.sources import shared_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""select c_custkey, o_orderkey, o_totalprice from customer,
    lateral (select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2)""")
def lateral_top_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The two dearest orders of each customer. Spark ranks per key and drops rows beyond the second before the shuffle."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    best = o.where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)
    return c.lateralJoin(best.select("o_orderkey", "o_totalprice")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""select s_suppkey, x.n, x.dearest from supplier left join
    lateral (select count(*) as n, max(l_extendedprice) as dearest from lineitem where l_suppkey = s_suppkey and l_quantity > 49) x on true""")
def lateral_supplier_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Number and highest price of each supplier's large lines; suppliers without any have 0 and null."""
    s, l = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    own = l.where((F.col("l_suppkey") == F.col("s_suppkey").outer()) & (F.col("l_quantity") > 49)).select(F.count("*").alias("n"), F.max("l_extendedprice").alias("dearest"))
    return s.lateralJoin(own, how="left").select("s_suppkey", "n", "dearest")


@query("""select vec_id, d, x from (select vec_id, embedding from embeddings) e,
    lateral (select d, e.embedding[d] as x from (select unnest(range(1, len(e.embedding) + 1)) as d) order by abs(x) desc, d limit 3)""")
def lateral_top_components(spark: SparkSession, sf: str) -> DataFrame:
    """The three components of largest size of each vector: the argument is the row's own vector."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    parts = F.transform("embedding", lambda x, k: F.struct((-F.abs(x)).alias("far"), (k + 1).cast("long").alias("d"), x.alias("x")))
    return e.select("vec_id", F.inline(F.slice(F.array_sort(parts), 1, 3))).select("vec_id", "d", "x")


def _frames(exclude: str) -> str:
    w = f"over (partition by o_custkey order by o_orderpriority groups between 1 preceding and 1 following exclude {exclude})"
    return f"select o_orderkey, sum(cast(o_totalprice * 100 as bigint)) {w} as f_sum, count(*) {w} as f_count from orders"


def _grouped(exclude: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        o = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
        out = windows.group_frame(o, ["o_custkey"], [F.col("o_orderpriority")], "cents", 1, 1, exclude, "f")
        return out.select("o_orderkey", F.col("f_sum"), F.col("f_count"))

    return run


for _name in windows.EXCLUDE:
    _key = f"window_groups_{_name.replace(' ', '_')}"
    QUERIES[_key] = _grouped(_name)
    ORACLES[_key] = _frames(_name).replace("cast(o_totalprice * 100 as bigint)", "cast(round(o_totalprice * 100) as bigint)").replace("as f_sum", "::bigint as f_sum")

GAP, DELAY = "30 minutes", "1 hour"


@query("""with s as (select user_id, segment, min(ts) as start, max(ts) as last, count(*) as n from (select *, sum(case when prev is null or epoch_us(ts) - epoch_us(prev) > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as segment
      from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)) group by segment, user_id)
    select user_id, start, last, n from s where last + interval 30 minutes + interval 1 microsecond <= date_trunc('millisecond', (select max(ts) from events)) - interval 1 hour""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the events read as a stream, as far as the watermark closed them."""
    kinds = table(spark, sf, "events").schema
    folder = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    events = spark.readStream.schema(kinds).parquet(f"{sf}/events.parque[t]")  # a pattern, as the table is one file or a folder
    run = streaming.keep(streaming.sessions(events, "user_id", "ts", GAP, DELAY), f"{folder}/table", f"{folder}/checkpoint")
    run.awaitTermination()
    found = spark.read.schema("user_id long, start timestamp, last timestamp, n long").parquet(f"{folder}/table")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")
