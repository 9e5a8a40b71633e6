"""Retrieval, routing, chunking and evaluation queries. documents play the chunks, embeddings their vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill import evaluation as ev
from tidemill import ingest
from tidemill import sql_functions
from tidemill import text as tx
from tidemill import vectors as v
from tidemill.sources import shared_dir, short_batches, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

QUERY_ID = 3
QUERY_TEXT = "the license of that version"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark: SparkSession, sf: str, vec_id: int = QUERY_ID):
    """The embedding of one row, as the caller of a search holds it."""
    return v.literal(table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def texts(spark: SparkSession, sf: str) -> DataFrame:
    short_batches(spark)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, with a null embedding where they have none."""
    return texts(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


COSINE = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"
QV = f"q as (select embedding from embeddings where vec_id = {QUERY_ID})"


@query(f"with {QV} select vec_id as id, label, round({COSINE}, 6) as similarity from embeddings e, q order by {COSINE} desc, vec_id limit 5")
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    return v.vector_search(embedded(spark, sf), query_vector(spark, sf)).select("id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"with {QV} select vec_id as id, label, round({COSINE}, 6) as similarity from embeddings e, q where label = 4 order by {COSINE} desc, vec_id limit 10")
def vec_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return v.vector_search(embedded(spark, sf), query_vector(spark, sf), 10, "label", 4).select("id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"with {QV} select id, row_number() over (order by s desc, id) as rank from (select vec_id as id, {COSINE} as s from embeddings e, q order by s desc, id limit 30)")
def vec_rownum_pool(spark: SparkSession, sf: str) -> DataFrame:
    return v.ranked(v.nearest(embedded(spark, sf), query_vector(spark, sf), 30), "similarity").select("id", F.col("rank").cast("long").alias("rank"))


@query(f"with {QV} select vec_id as id, round({COSINE}, 6) as similarity from embeddings e, q where label = 4 order by {COSINE} desc, vec_id limit 10")
def vec_table_function(spark: SparkSession, sf: str) -> DataFrame:
    """The search as a SQL table function, a default left out and others named."""
    embedded(spark, sf).select("id", F.lit(None).cast("string").alias("content"), "embedding", F.col("label").cast("string").alias("kind")).createOrReplaceTempView("tidemill_chunks")
    sql_functions.register(spark, "tidemill_chunks")
    vector = table(spark, sf, "embeddings").where(F.col("vec_id") == QUERY_ID).select("embedding").first()[0]
    numbers = ", ".join(f"{float(x)!r}d" for x in vector)
    return spark.sql(f"select id, round(similarity, 6) as similarity from vector_search(array({numbers}), filter_kind => '4', top_k => 10)")


#: The query set of whole searches: every row whose id is divisible by 20, against all rows.
EACH = 20
SQL_EACH = f"""c as (select q.vec_id as q, e.vec_id as id, e.label, {COSINE} as s from embeddings q, embeddings e where q.vec_id % {EACH} = 0),
    r as (select *, row_number() over (partition by q order by s desc, id) as rank from c"""


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % EACH == 0)


@query(f"with {SQL_EACH}) select q, id, label, round(s, 6) as similarity from r where rank <= 5")
def vec_topk_each(spark: SparkSession, sf: str) -> DataFrame:
    e = embedded(spark, sf)
    return v.nearest_of_each(e, asked(e), 5).join(e.select("id", "label"), "id").select("q", "id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"with {SQL_EACH} where label = 4) select q, id, label, round(s, 6) as similarity from r where rank <= 10")
def vec_topk_filtered_each(spark: SparkSession, sf: str) -> DataFrame:
    e = embedded(spark, sf)
    return v.nearest_of_each(e.where("label = 4"), asked(e), 10).select("q", "id", F.lit(4).alias("label"), F.round("similarity", 6).alias("similarity"))


@query(f"with {SQL_EACH}) select q, id, rank from r where rank <= 30")
def vec_rownum_pool_each(spark: SparkSession, sf: str) -> DataFrame:
    e = embedded(spark, sf)
    return v.nearest_of_each(e, asked(e), 30).select("q", "id", F.col("rank").cast("long").alias("rank"))


WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
GRAMS = "list_distinct(flatten(list_transform(" + WORDS + ", lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SQL_KEYWORD = f"""t as (select {GRAMS.format(f"'{QUERY_TEXT}'")} as q),
    g as (select doc_id as id, lang, {GRAMS.format("text")} as g from documents),
    s as (select id, lang, len(list_intersect(g, q)) / greatest(len(g) + len(q) - len(list_intersect(g, q)), 1) as keyword from g, t)"""


def trigram_score(content):
    return v.trigram_similarity(v.trigrams(content), v.trigrams(F.lit(QUERY_TEXT)))


@query(f"with {SQL_KEYWORD} select id, round(keyword, 6) as keyword from s where keyword > 0.02 order by s.keyword desc, id limit 30")
def kw_trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return v.keyword_search(texts(spark, sf), trigram_score, 30, 0.02).select("id", F.round("keyword", 6).alias("keyword"))


@query()
def kw_word_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return v.keyword_search(texts(spark, sf), v.word_similarity(QUERY_TEXT), 30).select("id", F.round("keyword", 6).alias("keyword"))


@query(f"""with {QV}, {SQL_KEYWORD.replace("from documents", "from documents where lang = 'en'")},
    c as (select e.vec_id as id, {COSINE} as similarity from embeddings e, q where e.vec_id in (select id from g)),
    vec as (select id, row_number() over (order by similarity desc, id) as r from c qualify r <= 30),
    kw as (select id, row_number() over (order by keyword desc, id) as r from s where keyword > 0.1 qualify r <= 30),
    f as (select coalesce(vec.id, kw.id) as id, coalesce(1.0::double / (60 + vec.r), 0) + coalesce(1.0::double / (60 + kw.r), 0) as score from vec full join kw on vec.id = kw.id)
    select f.id, lang, round(similarity, 6) as similarity, round(score, 9) as rrf_score from f join g on g.id = f.id left join c on c.id = f.id order by score desc, f.id limit 10""")  # fmt: skip
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    found = v.hybrid_search(passages(spark, sf), QUERY_TEXT, query_vector(spark, sf), 10, "lang", "en", score=trigram_score)
    return found.select("id", "lang", F.round("similarity", 6).alias("similarity"), F.round("rrf_score", 9).alias("rrf_score"))


@query()
def hybrid_word_similarity(spark: SparkSession, sf: str) -> DataFrame:
    found = v.hybrid_search(passages(spark, sf), QUERY_TEXT, query_vector(spark, sf), 10)
    return found.select("id", F.round("similarity", 6).alias("similarity"), F.round("rrf_score", 9).alias("rrf_score"))


#: The names under which the whole queries stood beside ones that read a part.
for _name, _same in {"kw_trigram_similarity_all": "kw_trigram_similarity", "hybrid_rrf_all": "hybrid_rrf"}.items():
    QUERIES[_name], ORACLES[_name] = QUERIES[_same], ORACLES[_same]

# ---- routing -------------------------------------------------------------------------------------------------------

SQL_ROUTE = """x as (select vec_id, label, embedding from embeddings qualify row_number() over (partition by label order by vec_id) <= 5),
    p as (select e.vec_id as id, e.label, x.label as predicted, max(list_cosine_similarity(e.embedding::double[], x.embedding::double[])) as similarity from embeddings e, x where e.vec_id not in (select vec_id from x) group by all),
    b as (select id, label, arg_max(predicted, row(similarity, -predicted)) as predicted, max(similarity) as similarity from p group by all)"""


def routed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    examples = e.withColumn("place", place).where("place <= 5").drop("place")
    questions = e.join(F.broadcast(examples.select("id")), "id", "left_anti")  # five examples a class
    return v.route(questions, examples.select("label", "embedding")).join(questions.select("id", "label"), "id")


@query(f"with {SQL_ROUTE} select id, label, predicted, round(similarity, 6) as similarity from b")
def route_nearest_example(spark: SparkSession, sf: str) -> DataFrame:
    return routed(spark, sf).select("id", "label", "predicted", F.round("similarity", 6).alias("similarity"))


@query(f"with {SQL_ROUTE} select label, cast(count(*) filter (label = predicted) as bigint) as hits, count(*) as total from b group by rollup (label)")
def route_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return ev.accuracy(routed(spark, sf).withColumn("ok", F.col("label") == F.col("predicted")), "label")


@query(f"with {SQL_ROUTE} select label, predicted, count(*) as n from b group by all")
def route_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return routed(spark, sf).groupBy("label", "predicted").agg(F.count("*").alias("n"))


# ---- evaluation ----------------------------------------------------------------------------------------------------

#: Every row of the query set is a question: expected are rows of its class, hits are the nearest 12 other rows.
SQL_HITS = f"""c as (select q.vec_id as q, e.vec_id as id, e.label, q.label as want, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s from embeddings q, embeddings e where q.vec_id % {EACH} = 0 and e.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by q order by s desc, id) as rank from c),
    p as (select q, id % 50 as doc, min(rank) as rank from r where rank <= 12 group by all),
    d as (select q, doc, row_number() over (partition by q order by rank, doc) as place from p),
    w as (select distinct q, id % 50 as doc from c where label = want)"""


def hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = embedded(spark, sf)
    near = v.nearest_of_each(e, asked(e), 13).where("id != q")  # the row itself may be among them
    rank = F.row_number().over(Window.partitionBy("q").orderBy("rank"))
    found = near.withColumn("rank", rank).where("rank <= 12").select("q", (F.col("id") % 50).alias("doc"), "rank")
    docs = e.groupBy(F.col("label").alias("want"), (F.col("id") % 50).alias("doc")).agg(F.count("*").alias("n"))
    questions = asked(e).select(F.col("id").alias("q"), F.col("label").alias("want"))
    expected = questions.join(docs, "want").where("n > 1 or doc != q % 50").select("q", "doc")  # other rows than the question's own
    return ev.distinct_positions(found), expected


@query(f"""with {SQL_HITS} select k, cast(count(*) filter (hit) as bigint) as hits, count(*) as total, count(*) filter (hit) * 100 // count(*) as percent
    from (select k, x.q, exists (select 1 from d join w on d.q = w.q and d.doc = w.doc where d.q = x.q and place <= k) as hit from (select distinct q from w) x, (values (3), (5)) k(k)) group by k""")
def hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    places, expected = hits(spark, sf)
    return ev.rate(ev.hit_at(places, expected, 3), "hit").withColumn("k", F.lit(3)).unionByName(ev.rate(ev.hit_at(places, expected, 5), "hit").withColumn("k", F.lit(5)))


@query(f"with {SQL_HITS} select q, doc, place from d")
def distinct_places(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf)[0].withColumn("place", F.col("place").cast("long"))


@query(f"""with {SQL_HITS}, g as (select q, doc from d), b as (select coalesce(g.q, w.q) as q, g.q is null as missing, w.q is null as extra from g full join w on g.q = w.q and g.doc = w.doc)
    select q, case when bool_or(missing) then 'wrong' when bool_or(extra) then 'over' else 'exact' end as grade from b group by q""")
def grade_sets(spark: SparkSession, sf: str) -> DataFrame:
    places, expected = hits(spark, sf)
    return ev.grade_sets(places.withColumnRenamed("doc", "id"), expected.withColumnRenamed("doc", "id"))


# ---- chunking ------------------------------------------------------------------------------------------------------

SQL_TOKENS = "cast(floor(len(regexp_extract_all({0}, '[가-힣一-鿿぀-ヿ]')) + len(regexp_extract_all({0}, '[A-Za-z0-9]+')) * 1.3::double) as integer)"


@query(f"select doc_id, {SQL_TOKENS.format('text')} as tokens from documents")
def chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


SQL_FOLD = f"""l as (select doc_id, k, p, {SQL_TOKENS.format('p')} as n from (select doc_id, unnest(range(1, len(ps) + 1)) as k, unnest(ps) as p from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as ps from documents))),
    f as (select doc_id, 1 as k, 0 as chunk, n as held from l where k = 1
      union all select l.doc_id, l.k, case when f.held + l.n > 400 then f.chunk + 1 else f.chunk end, case when f.held + l.n > 400 then l.n else f.held + l.n end from f join l on l.doc_id = f.doc_id and l.k = f.k + 1),
    c as (select f.doc_id, f.chunk as chunk_index, string_agg(l.p, chr(10) order by l.k) as content, sum(l.n) as n from f join l on l.doc_id = f.doc_id and l.k = f.k group by all)"""


def folded(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(tx.merged(lines, glue="\n")).alias("chunk_index", "content"))


@query(f"with recursive {SQL_FOLD} select doc_id, chunk_index, md5(content) as digest, length(content) as n_chars from c")
def chunk_fold_merge(spark: SparkSession, sf: str) -> DataFrame:
    return folded(spark, sf).select("doc_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"), F.length("content").cast("long").alias("n_chars"))


@query(f"with recursive {SQL_FOLD}, t as (select doc_id, {SQL_TOKENS.format('content')} as n from c) select doc_id, count(*) as n_chunks, cast(sum(n) // count(*) as bigint) as mean_tokens, cast(max(n) as bigint) as max_tokens from t group by doc_id")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tx.chunk_statistics(folded(spark, sf))


@query("""with s as (select doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\n#{2,3}[ \t]'), lambda x: trim(x)), lambda x: x <> '')) as p from documents) select doc_id, count(*) as sections from s group by doc_id""")
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.sections(F.col("text"))).cast("long").alias("sections")).where("sections > 0")


@query(f"with recursive {SQL_FOLD} select doc_id, chunk_index, case when starts_with(content, '# ') then content else '# Document ' || doc_id || chr(10) || chr(10) || content end as content from c")
def chunk_prefix_index(spark: SparkSession, sf: str) -> DataFrame:
    return folded(spark, sf).select("doc_id", "chunk_index", tx.titled(F.concat(F.lit("Document "), "doc_id"), F.col("content")).alias("content"))


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks of all documents: sections, merged, oversize ones split with overlap, titled."""
    title = F.concat(F.lit("Document "), "doc_id")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), title.alias("title"), F.lit("technical_doc").alias("type"), F.concat(F.col("doc_id"), F.lit(".md")).alias("filename"), F.col("text").alias("body"))
    return tx.chunks(d).select("doc_id", "chunk_index", "content")


@query(f"with recursive {SQL_FOLD} select count(*) as n_rows, count(distinct doc_id) as n_docs from c")
def load_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the chunks, verifies the written table and counts what is read from it."""
    loaded = ingest.full_refresh(folded(spark, sf), f"{shared_dir(spark)}/load_verify-{uuid.uuid4().hex}")
    return loaded.agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_docs"))


@query("select source, lang, count(*) as n, count(distinct text) as texts, sum(length(text)) as n_chars from documents group by all")
def documents_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.sum(F.length("text")).alias("n_chars"))


for _name, _same in {"hit_at_k_each": "hit_at_k", "distinct_places_each": "distinct_places", "grade_sets_each": "grade_sets", "chunk_prefix_all": "chunk_prefix_index"}.items():
    QUERIES[_name], ORACLES[_name] = QUERIES[_same], ORACLES[_same]
