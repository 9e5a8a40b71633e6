"""As-of and interval joins of events and orders: a user is the customer of the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import temporal
from tidemill.sources import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with o as (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey from orders group by all)
    select event_id, o_orderkey, o_orderdate from events e asof left join o on e.user_id = o.o_custkey and e.ts >= o.o_orderdate""")
def t_asof_order(spark: SparkSession, sf: str) -> DataFrame:
    """The last order of each event's user before the event."""
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return temporal.as_of(events, orders, "k", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey", "o_orderdate")


@query("""with p as (select user_id as u, ts as bought, max(row(value, event_id)) as x from events where event_type = 'purchase' group by all)
    select event_id, bought, x[1] as value, x[2] as purchase from (select * from events where event_type <> 'purchase') e asof left join p on e.user_id = p.u and e.ts >= p.bought""")
def t_asof_purchase(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase of the user before each other event; slices of six hours."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), "value", F.col("event_id").alias("purchase"))
    rest = events.where("event_type != 'purchase'").select("event_id", "user_id", "ts")
    return temporal.as_of(rest, bought, "user_id", "ts", "bought", ["value", "purchase"], 6 * 3600).select("event_id", "bought", "value", "purchase")


@query("""select s.event_id as signup, e.event_id as error from events s join events e on s.user_id = e.user_id and e.ts >= s.ts and e.ts < s.ts + interval 18 hours where s.event_type = 'signup' and e.event_type = 'error'""")
def t_interval_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The errors a user met within eighteen hours of a signup."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    held = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup"), F.col("ts").alias("from"), (F.col("ts") + F.expr("interval 18 hours")).alias("to"))
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), "ts")
    return temporal.interval_join(errors, held, ["user_id"], "ts", "from", "to", 6 * 3600).select("signup", "error")
