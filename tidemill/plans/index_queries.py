"""Searches by kept indexes: inverted lists of vectors, posting lists of trigrams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import kept
from tidemill import trigram_index as ti
from tidemill import vector_index as vi
from tidemill import vectors as v
from tidemill.plans.graph_queries import SQL_NODES
from tidemill.plans.search_queries import GRAMS, QUERY_TEXT, SQL_EACH, SQL_KEYWORD, WORDS, asked, embedded, passages, query_vector, texts
from tidemill.sources import nodes, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def vector_lists(spark: SparkSession, sf: str) -> vi.VectorIndex:
    """The kept index of all embeddings."""
    place = kept.once(spark, "vectors", [f"{sf}/embeddings.parquet"], lambda p: vi.build(embedded(spark, sf), p))
    return vi.open_index(spark, place)


def trigram_lists(spark: SparkSession, sf: str) -> ti.TrigramIndex:
    """The kept index of all documents."""
    return ti.TrigramIndex(kept.once(spark, "trigrams", [f"{sf}/documents.parquet"], lambda p: ti.build(texts(spark, sf), p)))


# ---- vectors -------------------------------------------------------------------------------------------------------


@query()
def vec_index_each(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest rows of each question in the cells that the calibration chose."""
    e = embedded(spark, sf)
    index = vector_lists(spark, sf)
    return vi.search_each(index, asked(e), 10).select("q", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"with {SQL_EACH}) select q, id, round(s, 6) as similarity, rank from r where rank <= 10")
def vec_index_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same search with every cell probed: the exact answer, from the lists."""
    e = embedded(spark, sf)
    index = vector_lists(spark, sf)
    found = vi.search_each(index, asked(e), 10, probes=len(index.centroids))
    return found.select("q", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {SQL_EACH}), p as (select * from r where rank <= 40 and label = 4),
    f as (select q, id, s, row_number() over (partition by q order by s desc, id) as rank from p) select q, id, round(s, 6) as similarity, rank from f where rank <= 10""")
def vec_index_filter_after(spark: SparkSession, sf: str) -> DataFrame:
    """The filter sees each question's forty nearest rows, so some questions get fewer than ten."""
    e = embedded(spark, sf)
    index = vector_lists(spark, sf)
    found = vi.search_each(index, asked(e), 10, F.col("label") == 4, probes=len(index.centroids))
    return found.select("q", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("select cast(count(*) // 20 + cast(count(*) % 20 > 0 as int) as bigint) as questions, (count(*) // 20 + cast(count(*) % 20 > 0 as int)) * 10 as wanted, true as enough from embeddings")
def vec_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the exact answer the index finds, over all questions: at least nine in ten."""
    e = embedded(spark, sf)
    index = vector_lists(spark, sf)
    found = vi.recall(vi.search_each(index, asked(e), 10), v.nearest_of_each(e, asked(e), 10))
    return found.select("questions", "wanted", (F.col("recall") >= 0.9).alias("enough"))


# ---- trigrams ------------------------------------------------------------------------------------------------------


@query(f"with {SQL_KEYWORD} select id, lang, round(keyword, 6) as keyword from s where keyword > 0.02 order by s.keyword desc, id limit 30")
def kw_trigram_index(spark: SparkSession, sf: str) -> DataFrame:
    """The best texts by trigram similarity, from posting lists; the table of texts is joined to the last rows."""
    index = trigram_lists(spark, sf)
    found = ti.search(index, spark, QUERY_TEXT, 30, 0.02)
    return texts(spark, sf).select("id", "lang").join(F.broadcast(found), "id").select("id", "lang", F.round("keyword", 6).alias("keyword"))  # thirty rows


@query()
def kw_word_index(spark: SparkSession, sf: str) -> DataFrame:
    """The best texts by word similarity; texts are read where the bound of the lists reaches the thirtieth score."""
    index = trigram_lists(spark, sf)
    return ti.word_search(index, texts(spark, sf), QUERY_TEXT, 30).select("id", F.round("keyword", 6).alias("keyword"))


@query()
def hybrid_word_index(spark: SparkSession, sf: str) -> DataFrame:
    """The hybrid search with its keyword axis from the posting lists."""
    index = trigram_lists(spark, sf)
    found = v.hybrid_search(passages(spark, sf), QUERY_TEXT, query_vector(spark, sf), 10, keyword=ti.word_search(index, texts(spark, sf), QUERY_TEXT, v.POOL))
    return found.select("id", F.round("similarity", 6).alias("similarity"), F.round("rrf_score", 9).alias("rrf_score"))


NAME_QUERY = "small red ring 7"
_STRETCH = "len(list_intersect(list_slice(g, i, j), q)) / (len(q) + len(list_distinct(list_slice(g, i, j))) - len(list_intersect(list_slice(g, i, j), q)))"


@query(f"""with {SQL_NODES}, t as (select {GRAMS.format(f"'{NAME_QUERY}'")} as q),
    l as (select id, name, flatten(list_transform({WORDS.format("name")}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) as g from n where type <> 'order'),
    d as (select distinct name, g from l),
    x as (select name, g, q, unnest(range(1, len(g) + 1)) as i from d, t), y as (select name, g, q, i, unnest(range(i, len(g) + 1)) as j from x),
    s as (select name, max({_STRETCH}) as keyword from y group by name)
    select id, l.name, round(keyword, 6) as keyword from l join s on s.name = l.name where keyword > 0.1 order by s.keyword desc, id limit 30""")  # fmt: skip
def kw_word_names(spark: SparkSession, sf: str) -> DataFrame:
    """The node names most similar to a phrase by word similarity: every stretch of every name."""
    n = nodes(spark, sf, ("customer", "part", "supplier", "nation")).select("id", F.col("name").alias("content"))
    index = ti.build(n, f"{shared_dir(spark)}/name-trigrams-{uuid.uuid4().hex}")
    found = ti.word_search(index, n, NAME_QUERY, 30)
    return n.join(F.broadcast(found), "id").select("id", F.col("content").alias("name"), F.round("keyword", 6).alias("keyword"))  # thirty rows
