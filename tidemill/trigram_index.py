"""A trigram index kept as tables: posting lists with set sizes, read by length and prefix bounds.

build() takes the trigrams of blocks of texts and writes one row for each block and distinct trigram, with the places in the
block of the texts that have it, in folders by a hash of the trigram, sorted within them; a row for each block, in a folder
of its own, holds the ids of its texts and the sizes of their whole sets. So a row is shuffled and sorted for a piece of a
list, not for each text in it. A search knows its few trigrams before the plan is made, so it opens their folders alone, and
within them the stretches of its trigrams; folders are cut into files by a hash of the block, so a trigram that all texts
have is no single task's work. Texts are not read until the last rows, if at all.

A text whose similarity is above the wanted one has between |q| * least and |q| / least trigrams (length bound) and at least
need = floor(|q| * least) of the query's, so one of any |q| - need + 1 of them (prefix bound): candidates come from the
rarest trigrams, and the lists of the common ones are only read for candidates.

word_search() ranks by word similarity. The part of the query's trigrams that a text has bounds its score from above and
comes from the lists. The texts with the best bounds are scored first, which gives the score of the last wanted place; then
only texts whose bound reaches that score are scored, so the answer is that of a full scan. The table of texts is scanned
and not shuffled: a bounded set of hashes of ids sieves it, and the exact join sees what passes.

Ids are unique, as those of rows are. Null texts and texts without words have no postings, so they are never found. A query
without words finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors as v
from .kept import cut
from .sources import short_batches

FOLDERS, FILE_BYTES = 64, 32_000_000
BLOCK = 1 << 22  #: bytes of the texts of a block; a longer text is a block of its own
SPREAD = 1 << 24  #: bytes of texts a task may get before they are dealt anew
PLACES = 1 << 20  #: hashes of ids in a sieve, at most


@dataclass(frozen=True)
class TrigramIndex:
    path: str
    id_type: str = "bigint"

    def table(self, spark: SparkSession) -> DataFrame:
        """The pieces of all lists (gram, block, places) and the blocks (block, ids, ns); texts: how many each holds."""
        return spark.read.schema(f"{_rows(self.id_type)}, folder int").parquet(f"{self.path}/postings")

    def shared(self, spark: SparkSession, grams: list[str]) -> DataFrame:
        """id, n, both: the texts that have some of these trigrams, the sizes of their sets, how many of these they have."""
        folders = spark.range(1).select(F.array(*[_folder(F.lit(g)) for g in grams])).first()[0]
        lists = self.table(spark).where(F.col("folder").isin(sorted(set(folders))) & F.col("gram").isin(grams))
        counted = lists.select("block", F.explode("places").alias("place")).groupBy("block", "place").agg(F.count("*").alias("both"))
        blocks = self.table(spark).where(F.col("folder") == FOLDERS).select("block", F.posexplode(F.arrays_zip("ids", "ns")).alias("place", "x"))
        return blocks.join(counted, ["block", "place"]).select(F.col("x.ids").alias("id"), F.col("x.ns").alias("n"), "both")

    def frequencies(self, spark: SparkSession, grams: list[str]) -> dict[str, int]:
        """How many texts have each of some trigrams."""
        rows = spark.read.schema("gram string, texts long").parquet(f"{self.path}/frequencies").where(F.col("gram").isin(grams)).collect()
        return {g: 0 for g in grams} | {r.gram: r.texts for r in rows}


def _rows(id_type: str) -> str:
    return f"gram string, block long, places array<int>, ids array<{id_type}>, ns array<int>, texts int"


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _letters(spark: SparkSession) -> bytes:
    """A bitmap of the signs that v.words() takes for letters or numbers, as Spark's regular expressions see them."""
    sign = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    found = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF)).where(sign.rlike(r"^[\p{L}\p{N}]$"))
    parts = found.groupBy(F.shiftright("id", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("id").bitwiseAND(32767))).collect()
    held = dict(tuple(r) for r in parts)  # 34 rows of 4 KB at most
    return b"".join(bytes(held.get(k, bytes(4096))) for k in range(0x110000 >> 15))


def _pieces(texts: pa.Array, letters: np.ndarray) -> tuple[pa.Array, pa.ListArray, np.ndarray]:
    """The distinct trigrams of lower-cased texts, for each the places of the texts that have it, and the size of each text's set.

    Signs are numbered, blanks and all that stand for them 0, so a trigram is a number: each letter with its neighbours, and
    each first letter of a word once more behind two blanks.
    """
    signs = np.frombuffer(("\n" + "\n".join(texts.to_pylist()) + "\n").encode("utf-32-le"), np.uint32)
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False) + 1
    of = np.repeat(np.arange(len(texts), dtype=np.int32), length + (np.arange(len(texts)) == 0))
    used = np.zeros(len(letters), bool)
    used[signs] = True
    alphabet = np.append(32, np.flatnonzero(used & letters))
    size = len(alphabet)
    number = np.zeros(len(letters), np.int32 if size**3 < 1 << 31 else np.int64)
    number[alphabet[1:]] = np.arange(1, size)
    sign = number[signs]
    at = np.flatnonzero(sign)
    before = sign[at - 1]
    first = at[before == 0]
    code = np.append((before * size + sign[at]) * size + sign[at + 1], sign[first])
    text = np.append(of[at], of[first])
    if size**3 <= 1 << 24:
        seen = np.zeros(size**3, bool)
        seen[code] = True
        grams = np.flatnonzero(seen)
        rank = np.empty(size**3, np.int32)
        rank[grams] = np.arange(len(grams))
        gram = rank[code]
    else:
        grams, gram = np.unique(code, return_inverse=True)
    pairs = gram.astype(np.int32 if len(grams) * len(texts) < 1 << 31 else np.int64) * np.int32(len(texts)) + text
    if len(grams) * len(texts) <= 1 << 25:
        seen = np.zeros(len(grams) * len(texts), bool)
        seen[pairs] = True
        pairs = np.flatnonzero(seen)
    else:
        pairs = np.unique(pairs)
    gram, text = np.divmod(pairs, len(texts))
    bounds = np.append(0, np.bincount(gram, minlength=len(grams)).cumsum()).astype(np.int32)
    joined = alphabet[np.stack((grams // size**2, grams // size % size, grams % size), axis=1)].astype(np.uint32).tobytes().decode("utf-32-le")
    names = pa.array([joined[i : i + 3] for i in range(0, len(joined), 3)], pa.string())
    return names, pa.ListArray.from_arrays(pa.array(bounds), pa.array(text.astype(np.int32))), np.bincount(text, minlength=len(texts))


def _lists(bitmap: bytes, block: int = BLOCK):
    """Rows for each block of texts (task, id, lower): the block, and its lists."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
        number, held, size = 0, [], 0

        def of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, ids, lower = (c.chunk(0) for c in pa.Table.from_batches(held).combine_chunks().columns)
            name = (task[0].as_py() << 32) + number
            grams, places, n = _pieces(lower, letters)
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), values)
            all_ids, all_n = whole(ids), whole(pa.array(n.astype(np.int32)))
            kinds = [pa.string(), pa.int64(), places.type, all_ids.type, all_n.type, pa.int32()]
            for columns in ([None, [name], None, all_ids, all_n, [len(ids)]], [grams, np.full(len(grams), name), places, None, None, pc.list_value_length(places)]):
                length = 1 if columns[0] is None else len(grams)
                filled = [pa.nulls(length, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(filled, ["gram", "block", "places", "ids", "ns", "texts"])

        for batch in rows:
            at = 0
            for k, length in enumerate(pc.binary_length(batch["lower"]).to_pylist()):
                if held_rows(held, k - at) and size + length > block:
                    yield from of([*held, batch.slice(at, k - at)])
                    number, held, size, at = number + 1, [], 0, k
                size += length
            held.append(batch.slice(at))
        if held_rows(held, 0):
            yield from of(held)

    def held_rows(held: list[pa.RecordBatch], more: int) -> int:
        return more + sum(b.num_rows for b in held)

    return run


def build(texts: DataFrame, path: str) -> TrigramIndex:
    """Writes the index of texts (id, content) to path."""
    index, spark = TrigramIndex(path.rstrip("/"), texts.schema["id"].dataType.simpleString()), texts.sparkSession
    short_batches(spark)
    texts = texts.where("content is not null").select("id", "content")
    dealt = texts.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("content"))).collect()  # a number for each task
    most = sum(size for _, size in dealt)
    files = max(1, most // (FOLDERS * FILE_BYTES))
    cores = spark.sparkContext.defaultParallelism
    if max((size for _, size in dealt), default=0) > max(SPREAD, 2 * most / cores):  # few tasks hold the rows, as those of one large row group
        texts = texts.repartition(max(cores, most // SPREAD), "id").sortWithinPartitions("id")  # a task run again makes the same blocks
    rows = texts.select(F.spark_partition_id().alias("task"), "id", F.lower("content").alias("lower"))
    rows = rows.mapInArrow(_lists(_letters(spark)), _rows(index.id_type))
    folder = F.when(F.col("gram").isNull(), F.lit(FOLDERS)).otherwise(_folder(F.col("gram")))
    rows = rows.withColumn("folder", folder).withColumn("_part", F.pmod(F.xxhash64("block"), F.lit(files)))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(FOLDERS * files, 10_000))
    rows.repartition(width, "folder", "_part").sortWithinPartitions("folder", "gram").drop("_part").write.partitionBy("folder").parquet(f"{index.path}/postings")
    counts = index.table(spark).where("gram is not null").groupBy("gram").agg(F.sum("texts").alias("texts"))
    counts.sortWithinPartitions("gram").write.parquet(f"{index.path}/frequencies")
    return index


def grams_of(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(v.trigrams(F.lit(text))).first()[0]


def _none(spark: SparkSession, index: TrigramIndex) -> DataFrame:
    return spark.createDataFrame([], f"id {index.id_type}, keyword double")


def similar(index: TrigramIndex, spark: SparkSession, query: str, least: float) -> DataFrame:
    """id, keyword of all texts whose trigram similarity to the query is above least, from the lists alone."""
    grams = grams_of(spark, query)
    size = len(grams)
    if not size:
        return _none(spark, index)
    known = index.frequencies(spark, grams)
    order = sorted(grams, key=lambda g: (known[g], g))
    need = max(1, math.floor(size * least - 1e-9))
    first, rest = order[: size - need + 1], order[size - need + 1 :]
    fits = (F.col("n") >= math.floor(size * least)) & (F.col("n") <= math.ceil(size / least) if least > 0 else F.lit(True))
    found = index.shared(spark, first).where(fits)
    if rest:
        more = index.shared(spark, rest).where(fits).join(found.select("id"), "id", "left_semi")
        found = found.unionByName(more).groupBy("id", "n").agg(F.sum("both").alias("both"))
    score = F.col("both") / F.greatest(F.col("n") + size - F.col("both"), F.lit(1))
    return found.select("id", score.alias("keyword")).where(F.col("keyword") > least)


def search(index: TrigramIndex, spark: SparkSession, query: str, k: int, least: float = 0.1) -> DataFrame:
    """id, keyword of the k texts with the best trigram similarity above least."""
    return similar(index, spark, query, least).orderBy(F.desc("keyword"), "id").limit(k)


def _scores(query: str, floor: float = 0.0):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: v.word_similarity_of(query, t, floor))

    return score


def _only(texts: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of texts whose id is in some: sieved by at most PLACES hashes where they are read, then joined and dealt over
    all tasks, however few read them."""
    place = F.pmod(F.xxhash64("id"), F.lit(PLACES)).alias("place")
    passed = texts.select("id", "content", place).join(F.broadcast(some.select(place).distinct()), "place", "left_semi")
    return passed.drop("place").join(some.select("id"), "id", "left_semi").repartition("id")


def word_search(index: TrigramIndex, texts: DataFrame, query: str, k: int, least: float = 0.1) -> DataFrame:
    """id, keyword of the k rows of texts (id, content) with the best word similarity above least."""
    spark = texts.sparkSession
    grams = grams_of(spark, query)
    if not grams:
        return _none(spark, index)
    bounds = cut(index.shared(spark, grams).select("id", (F.col("both") / len(grams)).alias("bound")).where(F.col("bound") > least), "bounds")
    scored = lambda some, floor: _only(texts, some).select("id", _scores(query, floor)(F.col("content")).alias("keyword"))
    best = sorted((r.keyword for r in scored(bounds.orderBy(F.desc("bound"), "id").limit(4 * k), 0.0).collect()), reverse=True)  # at most 4 * k numbers
    floor = best[k - 1] if len(best) >= k else 0.0
    ranked = scored(bounds.where(F.col("bound") >= floor), floor).orderBy(F.desc("keyword"), "id").limit(k)
    return ranked.where(F.col("keyword") > least)
