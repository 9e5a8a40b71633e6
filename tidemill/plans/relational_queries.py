"""The relational surface: aggregates, joins, windows, set operations and scalar functions over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.sources import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, *names: str):
    found = [table(spark, sf, n) for n in names]
    return found[0] if len(found) == 1 else found


def not_in(df: DataFrame, key: str, listed: DataFrame, column: str) -> DataFrame:
    """Rows of df whose key is NOT IN a column, as SQL has it: a null listed leaves none, a null key only if nothing is listed.

    A plain anti join, which shuffles both sides by the key, and one row with the counts of all and of null values.
    """
    counts = listed.agg(F.count("*").alias("_all"), F.count_if(F.col(column).isNull()).alias("_null"))
    keys = listed.where(F.col(column).isNotNull()).select(F.col(column).alias("_key")).distinct()
    kept = df.join(keys, F.col(key) == F.col("_key"), "left_anti").join(F.broadcast(counts), F.lit(True))  # one row
    return kept.where((F.col("_all") == 0) | ((F.col("_null") == 0) & F.col(key).isNotNull())).select(*df.columns)


def money(c):
    return F.round(c, 2)


@query("select round(sum(l_extendedprice), 2) as total from lineitem where l_returnflag = 'R' and l_shipdate >= timestamp '1996-01-01'")
def sql_sum_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").where("l_returnflag = 'R' and l_shipdate >= timestamp_ntz '1996-01-01 00:00:00'").agg(money(F.sum("l_extendedprice")).alias("total"))


@query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation where n_regionkey = 2)")
def sql_join_filter(spark: SparkSession, sf: str) -> DataFrame:
    c, n = _t(spark, sf, "customer", "nation")
    first = n.where("n_regionkey = 2").agg(F.min("n_name").alias("first"))
    return c.join(n.join(first, F.col("n_name") == F.col("first")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("select p_brand, round(sum(l_extendedprice), 2) as revenue from lineitem join part on l_partkey = p_partkey group by p_brand order by revenue desc, p_brand")
def sql_group_order(spark: SparkSession, sf: str) -> DataFrame:
    l, p = _t(spark, sf, "lineitem", "part")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(money(F.sum("l_extendedprice")).alias("revenue")).orderBy(F.desc("revenue"), "p_brand")


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 1")
def sql_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(1).select("c_custkey", "c_acctbal")


@query("select count(*) as n from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
def sql_count(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").agg(F.count("*").alias("n"))


@query("select o_orderpriority, count(*) as n from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by o_orderpriority")
def sql_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("select n_name, round(avg(s_acctbal), 4) as mean from supplier join nation on s_nationkey = n_nationkey group by n_name order by avg(s_acctbal) desc, n_name limit 1")
def sql_avg_top1(spark: SparkSession, sf: str) -> DataFrame:
    s, n = _t(spark, sf, "supplier", "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.avg("s_acctbal").alias("m")).orderBy(F.desc("m"), "n_name").limit(1).select("n_name", F.round("m", 4).alias("mean"))


@query("select c_mktsegment, count(o_orderkey) as orders, count(*) filter (o_orderkey is null) as without from customer left join orders on c_custkey = o_custkey group by c_mktsegment")
def sql_left_join(spark: SparkSession, sf: str) -> DataFrame:
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


@query("select r_name, s_suppkey from (select s_suppkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 9000) full join region on r_regionkey = n_regionkey and r_name < 'B'")
def sql_full_join(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = _t(spark, sf, "supplier", "nation", "region")
    rich = s.where("s_acctbal > 9000").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rich.join(r, (F.col("r_regionkey") == F.col("n_regionkey")) & (F.col("r_name") < "B"), "full").select("r_name", "s_suppkey")


@query("select c_nationkey, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) group by c_nationkey")
def sql_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("select p_brand, count(*) as n from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49) group by p_brand")
def sql_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    p, l = _t(spark, sf, "part", "lineitem")
    return not_in(p, "p_partkey", l.where("l_quantity > 49"), "l_partkey").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("select a.r_name as r1, b.r_name as r2 from region a cross join region b")
def sql_cross_join(spark: SparkSession, sf: str) -> DataFrame:
    r = _t(spark, sf, "region")
    return r.select(F.col("r_name").alias("r1")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("r2"))))  # the five regions


@query("select a.n_name as n1, b.n_name as n2 from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def sql_theta_join(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("n1"), F.col("b.n_name").alias("n2"))


PRICING = "l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n"


@query(f"select {PRICING} from lineitem group by l_returnflag, l_linestatus")
def sql_pricing(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("qty"), money(F.sum(F.expr("l_extendedprice * (1 - l_discount)"))).alias("revenue"), F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def sql_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def sql_cube(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def sql_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) >= 15")
def sql_having(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@query("select c_mktsegment, quantile_cont(c_acctbal, 0.5) as median, count(*) filter (c_acctbal < 0) as negative, bool_or(c_acctbal > 9990) as rich from customer group by c_mktsegment")
def sql_ordered_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", 0.5).alias("median"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.bool_or(F.col("c_acctbal") > 9990).alias("rich"))


@query("select r_name, string_agg(n_name, ',' order by n_name) as nations from nation join region on n_regionkey = r_regionkey group by r_name")
def sql_string_agg(spark: SparkSession, sf: str) -> DataFrame:
    n, r = _t(spark, sf, "nation", "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@query("select s_nationkey, s_suppkey, rank() over w as rk, dense_rank() over w as dr, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier window w as (partition by s_nationkey order by floor(s_acctbal / 1000))")
def sql_window_rank(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.floor(F.col("s_acctbal") / 1000))
    n = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return _t(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.row_number().over(n).cast("long").alias("rn"))


@query("select event_id, lag(value) over w as before, lead(event_type) over w as after, first_value(event_id) over w as first from events window w as (partition by user_id order by ts, event_id)")
def sql_window_lag(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.first("event_id").over(w).alias("first"))


@query("select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 3 preceding and current row), 4) as moving, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) as hour from events")
def sql_window_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    near = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return _t(spark, sf, "events").select("event_id", F.round(F.sum("value").over(rows), 4).alias("moving"), F.count("*").over(near).alias("hour"))


@query("select * from (select c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 3)")
def sql_top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return _t(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


@query("select o_custkey as k from orders where o_orderstatus = 'P' union select c_custkey from customer where c_acctbal < -900")
def sql_union(spark: SparkSession, sf: str) -> DataFrame:
    o, c = _t(spark, sf, "orders", "customer")
    return o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).union(c.where("c_acctbal < -900").select("c_custkey")).distinct()


@query("select o_orderpriority as p from orders where o_totalprice > 450000 intersect all select o_orderpriority from orders where o_orderstatus = 'P'")
def sql_intersect_all(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return o.where("o_totalprice > 450000").select(F.col("o_orderpriority").alias("p")).intersectAll(o.where("o_orderstatus = 'P'").select("o_orderpriority"))


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'F'")
def sql_except(spark: SparkSession, sf: str) -> DataFrame:
    c, o = _t(spark, sf, "customer", "orders")
    return c.select(F.col("c_custkey").alias("k")).subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("with big as (select o_custkey, sum(o_totalprice) as spent from orders group by o_custkey) select c_mktsegment, count(*) as n from big join customer on c_custkey = o_custkey where spent > (select avg(spent) from big) group by c_mktsegment")
def sql_cte(spark: SparkSession, sf: str) -> DataFrame:
    o, c = _t(spark, sf, "orders", "customer")
    big = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    mean = big.agg(F.avg("spent").alias("mean"))
    return big.join(F.broadcast(mean), F.col("spent") > F.col("mean")).join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))  # one row


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def sql_offset(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("select distinct c_nationkey, c_mktsegment from customer")
def sql_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("select p_partkey, upper(p_name) as up, substr(p_type, 1, 5) as kind, length(p_name) as n, p_size % 7 as m, case when p_size > 25 then 'large' else 'small' end as class, round(p_retailprice * 1.1, 2) as gross, coalesce(nullif(p_brand, 'Brand#11'), 'none') as brand, p_name like '%e%' as has_e from part")
def sql_scalars(spark: SparkSession, sf: str) -> DataFrame:
    e = F.expr
    return _t(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("up"), F.substring("p_type", 1, 5).alias("kind"), F.length("p_name").cast("long").alias("n"), e("p_size % 7").alias("m"), e("case when p_size > 25 then 'large' else 'small' end").alias("class"), F.round(F.col("p_retailprice") * 1.1, 2).alias("gross"), e("coalesce(nullif(p_brand, 'Brand#11'), 'none')").alias("brand"), F.col("p_name").like("%e%").alias("has_e"))


@query("select cast(date_trunc('month', o_orderdate) as date) as month, extract(year from o_orderdate) || '-Q' || extract(quarter from o_orderdate) as quarter, count(*) as n from orders group by all")
def sql_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return o.groupBy(F.trunc("o_orderdate", "month").alias("month"), F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))


@query("select event_type, cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by all")
def sql_json(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("select o_orderkey, cast(o_orderdate as date) as day, cast(o_totalprice as double) as total from orders order by o_orderkey limit 50")
def answer_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("double").alias("total")).orderBy("o_orderkey").limit(50)


#: Words of a question and the relation they speak for; earlier rows win.
LEXICON = [("head", "NATION_HEAD"), ("from", "IN_NATION"), ("lead", "LEADS"), ("manage", "MANAGES_ACCOUNT"), ("problem", "REPORTED_ISSUE"), ("the", "USES"), ("project", "HAS_PROJECT")]


@query(f"with x(place, word, relation) as (values {', '.join(f'''({k}, '{w}', '{r}')''' for k, (w, r) in enumerate(LEXICON))}) select conv_id, turn, arg_min(relation, place) as relation, count(*) as words from conversations join x on contains(lower(text), word) where role = 'user' group by conv_id, turn")
def question_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations that questions ask for, many questions at once, by a phrase table in place of a parser."""
    x = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(w).alias("word"), F.lit(r).alias("relation")) for k, (w, r) in enumerate(LEXICON)])
    found = F.filter(x, lambda e: F.contains(F.lower("text"), e["word"]))
    q = _t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(found).alias("x"))
    return q.groupBy("conv_id", "turn").agg(F.min_by("x.relation", "x.place").alias("relation"), F.count("*").alias("words"))


@query("select segment, user_id, min(ts) as start, count(*) as n from (select *, sum(case when prev is null or epoch_us(ts) - epoch_us(prev) > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as segment from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)) group by segment, user_id")
def sql_sessions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w).isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 1_800_000_000)
    e = _t(spark, sf, "events").withColumn("gap", gap.cast("long"))
    return e.withColumn("segment", F.sum("gap").over(w)).groupBy("segment", "user_id").agg(F.min("ts").alias("start"), F.count("*").alias("n"))
