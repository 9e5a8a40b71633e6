"""An approximate vector index kept as tables: inverted lists of cells, probed by a join on the cell.

build() fits centroids on a bounded sample, assigns every row to its nearest one and writes the lists sorted by cell, so a
search reads a cell's stretch of the files alone. How many cells a search probes is calibrated on the sample: the fewest that
find the wanted part of its own nearest rows, which lie further off than those of the whole table do. append() adds rows
with the centroids at hand, so loading goes on after the index exists.

search() serves one vector: its cells are known before the plan is made, so the scan of the lists is pruned by them.
search_each() serves a table of questions: they are dealt to the parts that hold the cells they probe, in one shuffle with the
lists. Small cells share a part and a large one is cut into blocks, so a part has about PART rows at most; it gets a question
once, however many of its cells that probes, keeps the best k for it, and only these are ranked. Both look at a pool of nearest
rows first and filter afterwards, so a filter can leave fewer than k rows; the exact searches of `vectors` filter first. Probing
all cells makes the answers exact.

The driver holds the sample and the centroids, both bounded by SAMPLE_BYTES, and the sizes of the cells, at most CELLS; only
centroids and the places of cells are broadcast. Rows without a vector, or with a zero one, are in no list; vectors of another
width than the first are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors as v

SAMPLE_BYTES = 64 << 20
SAMPLE = 16_384
CELLS = 65_536
#: Questions of the calibration, rounds of fitting, rows of a file of the lists.
TRIALS, ROUNDS, FILE_ROWS = 400, 8, 500_000
POOL = 40


@dataclass(frozen=True)
class VectorIndex:
    """Where the lists lie, the centroids as unit rows, and how many cells a search probes."""

    path: str
    centroids: np.ndarray
    probes: int

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]


def _rows(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return _unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def centroids_of(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit rows, from random distinct ones; a centroid without rows stays."""
    x = np.unique(x, axis=0)
    now = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        own = (x @ now.T).argmax(axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, own, x)
        empty = ~np.isin(np.arange(len(now)), own)
        sums[empty] = now[empty]
        now = _unit(sums)
    return now


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, seed: int = 6) -> int:
    """The fewest cells, nearest first, in which sample rows find that part of their k nearest other sample rows."""
    own = (x @ centroids.T).argmax(axis=1)
    asked = np.random.default_rng(seed).permutation(len(x))[:TRIALS]
    k = min(k, len(x) - 1)
    if k < 1 or not len(asked):
        return len(centroids)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centroids)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _assign(shared, width: int, most: int):
    """The rows with the cells nearest to their vector, most of them a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = -(_rows(batch["embedding"], width) @ shared.value.T)
            if most < near.shape[1]:
                first = np.argpartition(near, most - 1, axis=1)[:, :most]
            else:
                first = np.broadcast_to(np.arange(near.shape[1]), near.shape)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, first.size + 1, first.shape[1], dtype=np.int32)), pa.array(first.astype(np.int32).ravel()))
            yield batch.append_column("cells", cells)

    return run


def _added(rows: DataFrame, run, column: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {column}")


def _celled(rows: DataFrame, index: VectorIndex, most: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index.centroids)
    return _added(rows, _assign(shared, index.centroids.shape[1], most), "cells array<int>")


def _with_vector(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))


def _write(rows: DataFrame, index: VectorIndex, n: int, mode: str) -> None:
    placed = _celled(_with_vector(rows), index, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    files = max(1, -(-n // FILE_ROWS))
    placed.repartitionByRange(files, "cell", F.xxhash64("id")).sortWithinPartitions("cell", "id").write.mode(mode).parquet(f"{index.path}/lists")


def _measured(rows: DataFrame, width: int | None = None) -> tuple[int, int]:
    """Number and width of the vectors."""
    n, least, most = _with_vector(rows).agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n and (least != most or width not in (None, most)):
        raise ValueError(f"vectors of one width are wanted, not of {least} to {most}")
    return n, most or width or 1


def build(rows: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 10) -> VectorIndex:
    """Writes an index of rows (id, embedding and what filters need) to path and opens it.

    cells: by default about the root of the number of rows; recall: the part of the k nearest rows a search is to find.
    """
    spark = rows.sparkSession
    n, width = _measured(rows)
    bound = max(1, SAMPLE_BYTES // (8 * width))
    cells = max(1, min(cells or round(n**0.5), CELLS, bound))
    sample = _with_vector(rows).select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(min(max(SAMPLE, 8 * cells), bound)).toArrow()["embedding"]
    x = _rows(sample, width)
    centroids = centroids_of(x, cells) if len(x) else np.zeros((1, width))
    index = VectorIndex(path.rstrip("/"), centroids, probes_for(x, centroids, k, recall))
    _write(rows, index, n, "errorifexists")
    about = [(i, c.tolist(), index.probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(about, "cell int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{index.path}/centroids")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index written before."""
    found = spark.read.parquet(f"{path.rstrip('/')}/centroids").orderBy("cell").toArrow()
    return VectorIndex(path.rstrip("/"), np.array(found["centroid"].to_pylist(), np.float64), found["probes"][0].as_py())


def append(index: VectorIndex, rows: DataFrame) -> None:
    """Adds rows to the lists of an index."""
    n, _ = _measured(rows, index.centroids.shape[1])
    if n:
        _write(rows, index, n, "append")


def search(index: VectorIndex, spark: SparkSession, vector: list[float], k: int, where: Column | None = None, probes: int | None = None, pool: int = POOL) -> DataFrame:
    """The rows of the lists nearest to one vector, as similarity; the filter is applied to the pool of nearest ones."""
    if len(vector) != index.centroids.shape[1]:
        raise ValueError(f"a vector of width {index.centroids.shape[1]} is wanted")
    near = _unit(np.array([vector], np.float64))[0] @ index.centroids.T
    cells = np.argsort(-near, kind="stable")[: probes or index.probes].tolist()
    probed = index.lists(spark).where(F.col("cell").isin(cells)).drop("cell")
    found = v.nearest(probed, v.literal(vector), max(k, pool))
    return (found if where is None else found.where(where)).orderBy(F.desc("similarity"), "id").limit(k)


def _parts(lists: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the first of those it shares a part with and its number of blocks, 0 if it has no rows: neighbours in
    number share a part of at most PART rows, a larger cell has blocks of its own."""
    first, blocks = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    now, held = 0, v.PART
    for cell, n in lists.groupBy("cell").count().orderBy("cell").collect():
        if held + n > v.PART:
            now, held = cell, 0
        held += n
        first[cell], blocks[cell] = now, -(-n // v.PART)
    return first, blocks


def _dealt(shared, places, width: int, most: int, questions: int = 1024):
    """The rows with the parts that hold the cells nearest to their vector, most of them a row, and which of these each part holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, blocks = places.value
        pieces = (batch.slice(at, questions) for batch in batches for at in range(0, batch.num_rows, questions))
        for batch in _assign(shared, width, most)(pieces):
            row, cell = v.named_cells(batch)
            times = blocks[cell]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            part = first[cell] * (1 << 32) + block
            order = np.lexsort((part, row))
            row, cell, part = row[order], cell[order], part[order]
            start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            cells = pa.ListArray.from_arrays(pa.array(np.append(start, len(cell)).astype(np.int32)), pa.array(cell))
            of_row = np.searchsorted(row[start], np.arange(batch.num_rows + 1)).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(of_row), pa.StructArray.from_arrays([pa.array(part[start]), cells], ["part", "cells"]))
            yield batch.drop_columns(["cells"]).append_column("parts", parts)

    return run


def search_each(index: VectorIndex, questions: DataFrame, k: int, where: Column | None = None, probes: int | None = None, pool: int = POOL) -> DataFrame:
    """q, id, similarity, rank: for each of questions (id, embedding) the nearest k rows that its probed cells hold.

    where: a filter on the columns of the lists, applied to each question's pool of nearest rows.
    """
    spark = questions.sparkSession
    _measured(questions, index.centroids.shape[1])
    lists = index.lists(spark)
    first, blocks = _parts(lists, len(index.centroids))
    place = spark.createDataFrame([(int(c), int(first[c]), int(blocks[c])) for c in np.flatnonzero(blocks)], "cell int, first long, blocks int")
    kind = v.sent_as(lists, questions)
    row = lambda part, asked, cells: [part.alias("part"), F.lit(asked).cast("long").alias("asked"), F.col("id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("embedding"), cells.alias("cells")]
    held = lists.select("cell", "id", "embedding").join(F.broadcast(place), "cell")  # a row for each of at most CELLS cells
    held = held.select(*row(F.col("first") * (1 << 32) + F.pmod(F.xxhash64("id"), "blocks"), 0, F.array("cell")))
    shared = [spark.sparkContext.broadcast(x) for x in (index.centroids, (first, blocks))]
    probe = _dealt(*shared, index.centroids.shape[1], min(probes or index.probes, len(index.centroids)))
    probed = _added(_with_vector(questions.select("id", "embedding")), probe, "parts array<struct<part: bigint, cells: array<int>>>").withColumn("at", F.explode("parts"))
    both = held.unionByName(probed.select(*row(F.col("at.part"), 1, F.col("at.cells"))))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pool = k if where is None else max(k, pool)
    found = both.repartition(width, "part").sortWithinPartitions("part", "asked").mapInArrow(v._nearest_in_parts(pool), "q long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= pool)
    if where is None:
        return found
    kept = found.drop("rank").join(lists.where(where).select("id"), "id").withColumn("rank", rank)
    return kept.where(F.col("rank") <= k).select("q", "id", "similarity", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """questions, wanted, hits, recall: how much of exact (q, id) is in found, in one row."""
    both = exact.select("q", "id").join(found.select("q", "id", F.lit(1).alias("hit")), ["q", "id"], "left")
    total = both.agg(F.countDistinct("q").alias("questions"), F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    return total.withColumn("recall", F.col("hits") / F.col("wanted"))
