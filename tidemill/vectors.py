"""Vector, keyword and hybrid retrieval, and routing to the class of the nearest example.

Ranks always end in the id, so ties are settled. Rankings are cut by orderBy().limit(), which Spark runs as a top-k per
task; windows for rank numbers only see rows after that cut.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST, POOL = 10, 30
PART = 2048

_NEAREST = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector or another width."""
    return F.when(F.size(a) == F.size(b), _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0)))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def check(top_k: int, filter_value: str | None = None, allowed: tuple | None = None) -> None:
    """The argument rule of the search tools."""
    if not 1 <= top_k <= MOST:
        raise ValueError(f"top_k must be from 1 to {MOST}")
    if filter_value is not None and allowed is not None and filter_value not in allowed:
        raise ValueError(f"unknown filter value {filter_value}")


def filtered(chunks: DataFrame, column: str, value) -> DataFrame:
    return chunks if value is None else chunks.where(F.col(column) == value)


def nearest(chunks: DataFrame, query: Column, k: int) -> DataFrame:
    """The k rows with the largest cosine to the query, as similarity; chunks has id and embedding."""
    return chunks.withColumn("similarity", cosine(F.col("embedding"), query)).orderBy(F.desc_nulls_last("similarity"), "id").limit(k)


def ranked(df: DataFrame, score: str) -> DataFrame:
    """id, rank of rows that are already cut to few."""
    return df.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), "id")).alias("rank"))


def vector_search(chunks: DataFrame, query: Column, top_k: int = 5, filter_column: str | None = None, filter_value=None) -> DataFrame:
    check(top_k)
    return nearest(filtered(chunks, filter_column, filter_value), query, min(top_k, MOST))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products of the rows, summed in order as _dot does, so equal vectors tie wherever they lie."""
    out, step = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(a.T, np.ascontiguousarray(b.T), strict=True):
        np.multiply(x[:, None], y, out=step)
        out += step
    return out


def _lengths(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return np.sqrt(out)


def _by_width(piece: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    width = pc.list_value_length(piece["embedding"]).to_numpy(zero_copy_only=False)
    for w in np.unique(width).tolist():
        own = piece.filter(pa.array(width == w))
        yield w, own, own["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, w)


def sent_as(*tables: DataFrame) -> str:
    """The type in which the tables' vectors are shuffled: floats as they are, as doubles if there are others."""
    kinds = {t.schema["embedding"].dataType.simpleString() for t in tables}
    return "array<float>" if kinds == {"array<float>"} else "array<double>"


def named_cells(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of all that the rows name in cells; without that column they all name one."""
    if "cells" not in rows.schema.names:
        return np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int32)
    return pc.list_parent_indices(rows["cells"]).to_numpy(), rows["cells"].flatten().to_numpy()


def _nearest_in_parts(k: int, questions: int = 128):
    """Rows come sorted by part, those to be searched before the questions; each question gets the best k of the part, where
    rows have cells (one each) of those in the cells that it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, {}, {}
        for batch in batches:
            tag = batch["part"].to_numpy() * 2 + batch["asked"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tag)) + 1).tolist(), len(tag)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, asked = divmod(int(tag[lo]), 2) if hi > lo else (now, 0)
                if part != now:
                    now, held, ready = part, {}, {}
                for at in range(lo, hi, questions if asked else hi - lo):
                    piece = batch.slice(at, min(hi - at, questions) if asked else hi - lo)
                    for w, own, x in _by_width(piece):
                        ids, (near, cells) = own["id"].to_numpy(), named_cells(own)
                        if not asked:
                            held.setdefault(w, []).append((ids, x, cells))
                            continue
                        if w in held:
                            ready[w] = _by_cell(held.pop(w))
                        if w in ready:
                            yield _best(k, ids, x, near, cells, *ready[w])

    return run


def _by_cell(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, dict[int, tuple]]:
    """The ids in order; of each cell the places of its rows there, their vectors and lengths."""
    rows, cells = np.concatenate([i for i, _, _ in held]), np.concatenate([c for _, _, c in held])
    order = np.argsort(rows, kind="stable")
    y, cells = np.concatenate([x for _, x, _ in held])[order], cells[order]
    places = {c: np.flatnonzero(cells == c) for c in np.unique(cells).tolist()}
    return rows[order], {c: (at, y[at], _lengths(y[at])) for c, at in places.items()}


def _similar(k: int, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y; -inf where there is none, and below the k best of a row of x."""
    s = _dots(x, y)
    whole = _lengths(x)[:, None] * length
    np.divide(s, whole, out=s, where=whole > 0)
    s[~(whole > 0)] = -np.inf
    del whole
    if s.shape[1] > k:
        s[~(s >= np.partition(s, -k, axis=1)[:, -k, None])] = -np.inf
    return s


def _best(k: int, ids: np.ndarray, x: np.ndarray, near: np.ndarray, cells: np.ndarray, rows: np.ndarray, held: dict[int, tuple]) -> pa.RecordBatch:
    s = np.full((len(ids), len(rows)), -np.inf)
    for cell in np.unique(cells).tolist():
        if cell in held:
            at, y, length = held[cell]
            who = near[cells == cell]
            s[np.ix_(who, at)] = _similar(k, x[who], y, length)
    out = []
    for i, q in enumerate(ids.tolist()):
        found = np.flatnonzero(s[i] > -np.inf)
        found = found[np.argsort(-s[i, found], kind="stable")][:k]  # rows lie in the order of their ids
        out.append((np.full(len(found), q), rows[found], s[i, found]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), _NEAREST.types, strict=True)], schema=_NEAREST)


def nearest_of_each(rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """q, id, similarity, rank: for each of questions (id, embedding) the k rows (id, embedding) with the largest cosine.

    Rows are dealt into parts of about PART by their id; every question goes to every part, keeps the best k there, and
    only these are ranked. No table is broadcast or held whole. Rows without a cosine to a question are not found.
    """
    parts = max(1, -(-rows.count() // PART))
    kind = sent_as(rows, questions)
    pick = lambda df, part, asked: df.where("embedding is not null").select(part.alias("part"), F.lit(asked).cast("long").alias("asked"), F.col("id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("embedding"))
    both = pick(rows, F.pmod(F.xxhash64("id"), F.lit(parts)), 0).unionByName(pick(questions, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))), 1))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(width, "part").sortWithinPartitions("part", "asked").mapInArrow(_nearest_in_parts(k), "q long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# ---- keyword axis --------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """The lower-cased words, each with two blanks before and one after it."""
    return F.concat(F.lit("  "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   ")), F.lit(" "))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased words, each word with two blanks before and one after it."""
    return F.array_distinct(F.regexp_extract_all(words(text), F.lit(r"(?=([\S&&[^\uDC00-\uDFFF]]\S[\S ]| \S[\S ]|  \S))"), F.lit(1)))  # of all three signs in a row those within one word; none starts within a sign


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams. a is evaluated once."""
    of = F.transform(F.array(a), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_intersect(x, b)).alias("both")))[0]
    return F.transform(F.array(of), lambda x: x["both"] / F.greatest(x["n"] + F.size(b) - x["both"], F.lit(1)))[0]


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _gram_list(text: str) -> list[str]:
    return [f"  {w} "[i : i + 3] for w in _words(text) for i in range(len(w) + 1)]


def _gram_codes(text: str) -> np.ndarray:
    """The same list as numbers, 21 bits a sign."""
    sign = np.frombuffer(("  " + "   ".join(_words(text)) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first, middle, last = sign[:-2], sign[1:-1], sign[2:]
    return ((first << 42) | (middle << 21) | last)[(middle != 32) | ((first == 32) & (last != 32))]


def word_similarity_of(query: str, text: str, floor: float = 0.0) -> float:
    """The largest similarity of the query's trigram set and any stretch of the text's trigram list. One below floor may
    come out as another number below floor.

    A best stretch starts at a shared trigram. A trigram is new in a stretch if it last occurred before the stretch, so
    running sums give the similarities of all stretches from many starts at once; a start is done when even all shared
    trigrams, with no others than those it has already met, could not beat the best so far.
    """
    wanted, grams = np.unique(_gram_codes(query)), _gram_codes(text)
    hit = np.isin(grams, wanted)
    starts, size = np.flatnonzero(hit), len(wanted)
    if not len(starts):
        return 0.0
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    before = np.full(len(grams), -1)
    before[order[1:][again]] = order[:-1][again]
    best, width = floor * (1 - 1e-9), min(16, len(grams))
    while len(starts):
        before = np.append(before[: len(grams)], np.full(width, len(grams)))  # beyond the end nothing is new
        wide = np.append(hit[: len(grams)], np.zeros(width, bool))
        left = []
        for k in range(0, len(starts), max(1, (1 << 18) // width)):
            part = starts[k : k + max(1, (1 << 18) // width)]
            at = part[:, None] + np.arange(width)
            new = before[at] < part[:, None]
            distinct, shared = new.cumsum(axis=1), (new & wide[at]).cumsum(axis=1)
            best = max(best, float((shared / (size + distinct - shared)).max()))
            left.append(part[((size + distinct[:, -1] - shared[:, -1]) * best < size) & (part + width < len(grams))])
        starts = np.concatenate(left)
        width = min(2 * width, len(grams))
    return best


def word_similarity(query: str, least: float = 0.1, most: int = POOL) -> Callable[[Column], Column]:
    """Word similarity for a ranking: exact for rows that can be above least and among the `most` best, 0 for others.

    No stretch of a text can be more similar than the part of the query's trigrams that the whole text has. That bound
    needs a few searches for substrings; rows whose bound is below the best scores of their task so far are not scored.
    """
    wanted = sorted(set(_gram_list(query)))

    def bound(text: str) -> float:
        padded = "  " + "   ".join(_words(text)) + " "
        return sum(g in padded for g in wanted) / max(1, len(wanted))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        best: list[float] = []
        for part in texts:
            found = np.zeros(len(part))
            for k, text in enumerate(part):
                if text and (top := bound(text)) > least and (len(best) < most or top >= best[0]):
                    found[k] = word_similarity_of(query, text)
                    if found[k] > least:
                        (heapq.heappush if len(best) < most else heapq.heappushpop)(best, found[k])
            yield pd.Series(found)

    return score.asNondeterministic()  # what is skipped depends on the rows before


def keyword_search(chunks: DataFrame, score: Callable[[Column], Column], k: int, least: float = 0.1) -> DataFrame:
    """The k rows with the best keyword score above least; chunks has id and content. The few best are filtered, so no row
    is scored a second time for a filter."""
    return chunks.withColumn("keyword", score(F.col("content"))).orderBy(F.desc("keyword"), "id").limit(k).where(F.col("keyword") > least)


def hybrid_search(chunks: DataFrame, query_text: str, query: Column, top_k: int = 5, filter_column: str | None = None, filter_value=None, rrf_k: int = 60, pool: int = POOL, score: Callable[[Column], Column] | None = None, keyword: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion of both axes: the rows of chunks with similarity (cosine) and rrf_score, by the latter.

    keyword: the best pool rows of the keyword axis (id, keyword), where an index has found them already.

    Rows without an embedding have no rank on the vector axis and a null similarity; the keyword axis reads all rows. Only
    ids and ranks of at most pool rows an axis are fused; wide columns are joined to the few results at the end.
    """
    check(top_k)
    wanted = filtered(chunks, filter_column, filter_value)
    vec = ranked(nearest(wanted.where("embedding is not null").select("id", "embedding"), query, pool), "similarity").withColumnRenamed("rank", "vec_rank")
    if keyword is None:
        keyword = keyword_search(wanted.select("id", "content"), score or word_similarity(query_text, most=pool), pool)
    kw = ranked(keyword, "keyword").withColumnRenamed("rank", "kw_rank")
    part = lambda c: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    fused = vec.join(kw, "id", "full_outer").select("id", (part("vec_rank") + part("kw_rank")).alias("rrf_score"))
    best = fused.orderBy(F.desc("rrf_score"), "id").limit(min(top_k, MOST))
    return wanted.join(F.broadcast(best), "id").withColumn("similarity", cosine(F.col("embedding"), query)).orderBy(F.desc("rrf_score"), "id")


def route(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """id, predicted, similarity: the class of the nearest labelled example; the smaller label wins ties.

    examples (label, embedding) is a small labelled set of fixed size; it is folded into one row and broadcast, so every
    question is compared with all examples where it is read.
    """
    row = examples.agg(F.collect_list(F.struct("label", "embedding")).alias("examples"))
    scored = questions.crossJoin(F.broadcast(row)).withColumn("best", F.array_max(F.transform("examples", lambda x: F.struct(cosine(F.col("embedding"), x["embedding"]).alias("similarity"), (-x["label"]).alias("minus"), x["label"].alias("label")))))
    return scored.select("id", F.col("best.label").alias("predicted"), F.col("best.similarity").alias("similarity"))
