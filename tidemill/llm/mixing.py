"""Mixing sources to target weights, in DataFrame functions only.

Method: a multivariate-hypergeometric splitting tree over source blocks. Documents of a source fall into 256 blocks by a
keyed digest, which is a random permutation of the source. A source's target gives whole passes over all its blocks and a
part pass over the first blocks of the permutation; in the one marginal block the documents are taken in permuted order
up to the missing words, then the one document of the source whose size comes nearest to the rest. So quotas of blocks are exact. The tree splits the
block copies of all sources among the output shards: every node sends a random half of its copies to the left, which is
a multivariate hypergeometric draw of its source counts, and so on to single shards. A shard then holds disjoint permuted
blocks, and its rows are ordered by another keyed digest.

Only the slim table of ids and sizes is shuffled, by source and block, so a hot source is spread over its blocks; tables
of blocks have at most 256 rows a source. Ids decide the permutation: reruns agree, whatever the partitioning.

Edge cases: a null or wordless text has size 0 and takes 0 words. A null source is a source, ordered last. Null ids count
as the text 'null'; rows with equal ids keep together in the permutation, shorter texts first, equal rows are
interchangeable (if the last pick has equal rows, all of them are taken). Sources without words get target 0. An empty table gives an empty result. mix() keeps all columns but those named mix_*
that it makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BLOCKS, LEVELS, SEED = 256, 3, "mix-1"


def _digest(*parts) -> Column:
    """60 bits of the md5 of the parts."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    size = F.expr(f"cast(regexp_count(coalesce(text, ''), r'{WORD}') as bigint)")
    key = _digest(F.col("doc_id"))
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.pmod(key, F.lit(BLOCKS)).alias("block"))


def targets(blocks: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """source, source_size, target: the level at which capped shares by weight fill up share times all words."""
    by_source = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = by_source.withColumn("weight", w.cast("long"))
    ratio = (F.col("source_size") * cap).cast("double") / F.col("weight")
    full_first = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    everything, before, rest = Window.partitionBy(F.lit(1)), full_first.rowsBetween(Window.unboundedPreceding, -1), full_first.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    x = x.withColumn("ratio", ratio).withColumn("level", level)
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), (F.col("source_size") * cap).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return x.select("source", "source_size", target.alias("target"))


def plan(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with their passes; block copies with their shards."""
    blocks = slim.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = cut(blocks, "blocks")
    of_source = targets(blocks).withColumnRenamed("source", "s")
    x = blocks.join(of_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    x = x.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    x = x.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    x = x.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("block")))
    left = F.col("rest") - (F.col("upto") - F.col("words"))
    x = x.withColumn("missing", F.when(F.col("upto") <= F.col("rest"), F.lit(None)).when(left > 0, left).cast("double")).withColumn("whole", F.col("upto") <= F.col("rest"))
    x = cut(x.select("source", "block", "source_size", "target", "full", "whole", "missing"), "plan")
    copies = x.where("full > 0 or whole or missing is not null").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("full") + F.when(F.col("whole") | F.col("missing").isNotNull(), 1).otherwise(0))).alias("copy"))
    copies = copies.where("copy > 0").withColumn("shard", F.lit(0))
    for level in range(LEVELS):
        node = Window.partitionBy("shard")
        place = F.row_number().over(node.orderBy(_digest(F.lit(level), F.col("source"), F.col("block"), F.col("copy")), F.col("source").asc_nulls_last(), "block", "copy"))
        copies = copies.withColumn("place", place).withColumn("n", F.count("*").over(node))
        copies = copies.withColumn("shard", F.col("shard") * 2 + F.when(F.col("place") * 2 > F.col("n"), 1).otherwise(0)).drop("place", "n")
    return x, copies


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, shards (of the copies, comma-joined) of every row."""
    slim = cut(sizes(docs), "sizes")
    blocks, copies = plan(slim)
    shards = copies.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    b = blocks.join(shards.withColumnsRenamed({"source": "s2", "block": "b2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")), "left").drop("s2", "b2").withColumnsRenamed({"source": "s", "block": "b"})
    x = slim.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    margin = x.where("missing is not null")
    key = Window.partitionBy("source", "block")
    permuted = key.orderBy("key", "size")
    margin = margin.withColumn("upto", F.sum("size").over(permuted.rowsBetween(Window.unboundedPreceding, 0))).withColumn("part", F.col("upto") <= F.col("missing"))
    gaps = margin.groupBy("source").agg((F.max("missing") - F.coalesce(F.max(F.when(F.col("part"), F.col("upto"))), F.lit(0))).alias("gap")).withColumnRenamed("source", "s")
    every = x.where("missing is null").withColumn("part", F.col("whole")).unionByName(margin.drop("upto"))
    off = F.abs(F.col("size") - F.col("gap"))
    picks = every.where("not part").join(gaps, F.col("source").eqNullSafe(F.col("s"))).where(off < F.col("gap")).groupBy("s").agg(F.min(F.struct(off.alias("off"), "key", "size")).alias("pick"))
    every = every.join(picks, F.col("source").eqNullSafe(F.col("s")), "left")
    every = every.withColumn("part", F.col("part") | F.coalesce((F.col("key") == F.col("pick.key")) & (F.col("size") == F.col("pick.size")), F.lit(False))).drop("s", "pick")
    n = F.col("full") + F.col("part").cast("long")
    every = every.withColumn("copies", n).withColumn("shards", F.expr(f"slice(concat(coalesce(shards, array()), array(cast(key % {1 << LEVELS} as int))), 1, cast(copies as int))"))
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), "source", n.alias("copies"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"), "key")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, sorted into shards: all columns, then mix_shard and mix_order.

    Rows are matched to their decisions by id and size; rows with equal id and size get the same copies.
    """
    chosen = mixed_sizes(docs).where("copies > 0").groupBy("doc_id", "size").agg(F.max("shards").alias("mix_shards")).withColumnsRenamed({"doc_id": "mix_id", "size": "mix_size"})
    size = F.expr(f"cast(regexp_count(coalesce(text, ''), r'{WORD}') as bigint)")
    docs = docs.drop("mix_id", "mix_size", "mix_shards", "mix_n", "mix_copy", "mix_shard", "mix_order")
    x = docs.withColumn("mix_n", size)
    x = x.join(chosen, F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("mix_n") == F.col("mix_size"))).drop("mix_id", "mix_size", "mix_n")
    own = docs.columns
    x = x.select(*own, F.posexplode(F.split("mix_shards", ",")).alias("mix_copy", "mix_shard")).withColumn("mix_shard", F.col("mix_shard").cast("int"))
    return x.select(*own, "mix_shard", _digest(F.lit("order"), F.col("doc_id"), F.col("mix_copy")).alias("mix_order"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(documents(spark, sf_dir)).drop("key")


def oracle() -> str:
    def digest(*parts: str) -> str:
        return f"('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(f'''coalesce(cast({p} as varchar), 'null')''' for p in parts)})), 1, 15))::bigint"

    copies = "copies0"
    tree = ""
    for level in range(LEVELS):
        tree += f""",
    copies{level + 1} as (select source, block, copy, shard * 2 + case when row_number() over (partition by shard order by {digest(str(level), 'source', 'block', 'copy')}, source nulls last, block, copy) * 2 > count(*) over (partition by shard) then 1 else 0 end as shard from {copies})"""
        copies = f"copies{level + 1}"
    return f"""
    with slim as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size, {digest('doc_id')} as key from documents),
    s0 as (select source, cast(sum(size) as bigint) as source_size from slim group by source),
    s1 as (select *, [{', '.join(map(str, WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as weight from s0),
    s2 as (select *, cast(source_size * {CAP} as double) / weight as ratio from s1),
    s3 as (select *, (cast(sum(source_size) over () as double) * {SHARE} - coalesce(sum(source_size * {CAP}) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from s2),
    s4 as (select source, source_size, case when l is null or ratio < l then cast(source_size * {CAP} as double) else l * weight end as target from s3, (select arg_min(level, ratio) as l from s3 where level <= ratio)),
    b0 as (select source, key % {BLOCKS} as block, sum(size) as words from slim group by all),
    b1 as (select b0.source, block, words, source_size, target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as "full", sum(words) over (partition by b0.source order by block) as upto from b0 join s4 on b0.source is not distinct from s4.source),
    b2 as (select *, target - "full" * source_size as rest from b1),
    b3 as (select *, upto <= rest as whole, case when upto > rest and rest - (upto - words) > 0 then cast(rest - (upto - words) as double) end as missing from b2),
    copies0 as (select source, block, unnest(range(1, "full" + case when whole or missing is not null then 2 else 1 end)) as copy, 0 as shard from b3){tree},
    sh as (select source, block, list(shard order by copy) as shards from {copies} group by source, block),
    x0 as (select slim.*, b3.block, b3.source_size, b3.target, "full", whole, missing, shards from slim join b3 on slim.source is not distinct from b3.source and key % {BLOCKS} = b3.block left join sh on sh.source is not distinct from b3.source and sh.block = b3.block),
    x1 as (select *, sum(size) over (partition by source, block order by key, size rows between unbounded preceding and current row) <= missing as part, sum(size) over (partition by source, block order by key, size rows between unbounded preceding and current row) as upto from x0),
    gaps as (select source, max(missing) - coalesce(max(case when part then upto end), 0) as gap from x1 where missing is not null group by source),
    x2 as (select * exclude (part), case when missing is null then whole else part end as part from x1),
    picks as (select x2.source, min(struct_pack(o := abs(size - gap), k := key, z := size)) as pick from x2 join gaps on x2.source is not distinct from gaps.source where not part and abs(size - gap) < gap group by x2.source),
    x4 as (select x2.*, part or coalesce(key = pick.k and size = pick.z, false) as chosen from x2 left join picks on x2.source is not distinct from picks.source),
    x5 as (select *, "full" + cast(chosen as bigint) as copies from x4)
    select doc_id, size, source_size, target, size * copies as taken, source, copies, array_to_string(list_concat(coalesce(shards, []), [key % {1 << LEVELS}])[:copies], ',') as shards from x5"""
