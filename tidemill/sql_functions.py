"""The searches as SQL table functions with defaults and named arguments, over a view of the caller.

    register(spark, "chunks")
    spark.sql("select * from vector_search(array(0.1d, 0.2d), top_k => 3)")

The view has id, content, embedding (array of numbers) and kind (string). Arguments must be constants: Spark puts them into
the plan, so a null kind leaves no filter and a rank limit becomes a top-k of each task. word_similarity(query, text) is a
function of its own, exact for every row; vectors.hybrid_search leaves out rows that can't be among the best.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .vectors import MOST, POOL, word_similarity_of


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with(cast({a} as array<double>), {b}, (x, y) -> x * y), 0d, (s, x) -> s + x)"


COSINE = f"case when size(embedding) = size(query_embedding) then {_dot('embedding', 'query_embedding')} / nullif(sqrt({_dot('embedding', 'cast(embedding as array<double>)')}) * sqrt({_dot('query_embedding', 'query_embedding')}), 0d) end"


def _word_similarity(queries: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([word_similarity_of(q, t) if q and t else 0.0 for q, t in zip(queries, texts, strict=True)], dtype=float)


def register(spark: SparkSession, view: str) -> None:
    """Defines vector_search, hybrid_search and word_similarity in the session. Rows without a cosine come last, by
    id; those without an embedding have no rank on the vector axis of hybrid_search."""
    spark.udf.register("word_similarity", F.pandas_udf(_word_similarity, "double"))
    near = f"select id, content, kind, {COSINE} as similarity, embedding is not null as embedded from {view} where filter_kind is null or kind = filter_kind"
    ranked = "row_number() over (order by {0} desc nulls last, id) as place"
    spark.sql(f"""create or replace temporary function vector_search(query_embedding array<double>, top_k int default 5, filter_kind string default null)
        returns table (id bigint, content string, kind string, similarity double)
        return select id, content, kind, similarity from (select *, {ranked.format("similarity")} from ({near})) where place <= least(top_k, {MOST})""")
    spark.sql(f"""create or replace temporary function hybrid_search(query_text string, query_embedding array<double>, top_k int default 5, filter_kind string default null, rrf_k int default 60, candidate_pool int default {POOL})
        returns table (id bigint, content string, kind string, similarity double, rrf_score double)
        return with c as ({near}),
            vec as (select id, place from (select id, {ranked.format("similarity")} from c where embedded) where place <= candidate_pool),
            words as (select id, word_similarity(query_text, content) as keyword from c),
            kw as (select id, place from (select id, {ranked.format("keyword")} from words where keyword > 0.1) where place <= candidate_pool),
            fused as (select coalesce(vec.id, kw.id) as id, coalesce(1d / (rrf_k + vec.place), 0d) + coalesce(1d / (rrf_k + kw.place), 0d) as rrf_score from vec full outer join kw on vec.id = kw.id),
            best as (select * from (select *, {ranked.format("rrf_score")} from fused) where place <= least(top_k, {MOST}))
            select c.id, content, kind, similarity, rrf_score from best join c on c.id = best.id""")
