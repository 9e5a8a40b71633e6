"""Near-duplicate groups of embeddings by an inverted multi-index and exact cosine checks.

Method: two codebooks, fitted apart on the first and second halves of the unit vectors, make a product grid of cells. Each
vector lies in its home cell. From there it visits the cells in rising order of how far it would have to move to get into
them: (distance to the border with a centroid's region) squared, summed over both halves. Both lists are sorted, so the
multi-sequence traversal up to a radius is the staircase under the sum, cut out for many vectors at once. The radius is
calibrated on the sample: pairs at just the least cosine, in random directions, must meet in a cell, from either of their
homes, with the target recall. Closer pairs meet more often. With recall=1 the radius is the largest move any such pair can
make, which finds every pair for certain and visits far more cells.

In a cell, visitors are compared with its residents and residents with each other by the whole vectors in double precision.
A pair that meets in both homes counts in the smaller one only. Cells are cut into blocks of about BLOCK rows and each pair
of blocks is a task's group, so no cell has to fit into a task; such a task returns counts and a spanning forest of its
links, at most a row a vector, never its pairs. Equal vectors of a label are one class with a weight from the start, so
copies never multiply. Distinct vectors that are all near each other are counted in pairs of blocks, as exact link counts need.

Only the codebooks (bounded by GRID and WIDE) are broadcast. They are fitted by the driver on at most SAMPLE vectors, chosen
by a hash; every vector is indexed.

Edge cases: a null label, and a vector that is null, empty, zero or has a null or non-finite component, links with nothing:
n_links 0, its own component. Vectors of different lengths are not compared. Rows of one id are vectors of their own. A null
id stands for itself (component_id null, unless linked; kept is false for a linked one and true otherwise). An empty table
gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, shuffle_width
from .components import connected_components

THRESHOLD, RECALL = 0.93, 0.9999
SAMPLE, ROUNDS, TRIALS = 8192, 10, 4
#: Centroids of a half, by the vectors of the largest label; coordinates of a half the grid looks at (checks see all).
GRID, WIDE, RESIDENTS = (8, 256), 256, 32
BLOCK = 1024
SALTS = 16

_INDEXED = "class long, label {label}, embedding {embedding}, weight long, width int, home int, visits array<int>"
_LINKED = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("hub", pa.int64())])


def comparable(label: Column, embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0)


def _matrix(vectors: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """Vectors of one width as unit rows; a power of two first keeps squares within range."""
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _halves(x: np.ndarray, size: int = WIDE) -> list[np.ndarray]:
    """What the grid sees of unit rows: the first coordinates of each half, filled up with zeros."""
    cut_ = (x.shape[1] + 1) // 2
    out = [np.zeros((len(x), size)) for _ in range(2)]
    for to, part in zip(out, (x[:, :cut_], x[:, cut_:]), strict=True):
        to[:, : min(size, part.shape[1])] = part[:, :size]
    return out


def _by_width(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    width = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for w in np.unique(width).tolist():
        yield w, np.flatnonzero(width == w)


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's rounds, from random distinct rows; a centroid without rows stays."""
    x = np.unique(x, axis=0)
    centroids = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = _squares(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centroids))[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    return centroids


def moves(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the square of the least move of the row into the region of each centroid."""
    d = _squares(x, centroids)
    home = d.argmin(axis=1)
    apart = np.sqrt(np.maximum(_squares(centroids, centroids), 1e-24))
    least = np.maximum(d - d[np.arange(len(x)), home][:, None], 0) / (2 * apart[home])
    least[np.arange(len(x)), home] = 0
    return home, least * least


def radius(books: list[np.ndarray], halves: list[np.ndarray], widths: np.ndarray, threshold: float, recall: float) -> float:
    """The largest sum of squared moves at which a cell is visited."""
    if recall >= 1 or not len(widths):
        return 2 - 2 * threshold + 1e-9
    rng, need = np.random.default_rng(7), []
    for _ in range(TRIALS):
        there = back = 0.0
        for x, book in zip(halves, books, strict=True):
            y = threshold * x + math.sqrt(1 - threshold * threshold) * rng.standard_normal(x.shape) / np.sqrt(widths)[:, None]
            (hx, mx), (hy, my) = moves(x, book), moves(y, book)
            there, back = there + mx[np.arange(len(x)), hy], back + my[np.arange(len(x)), hx]
        need.append(np.minimum(there, back))
    return min(float(np.quantile(np.concatenate(need), recall)), 2 - 2 * threshold) + 1e-9


def staircase(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row, the pairs (i, j) with first[i] + second[j] <= most: two sorted lists walked against each other."""
    for u, v in zip(first, second, strict=True):
        by_u, by_v = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
        steps = np.searchsorted(v[by_v], most - u[by_u], side="right")
        yield np.repeat(by_u, steps), by_v[np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)]


def _index(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, most = shared.value
        side = len(books[1])
        for batch in batches:
            homes, visits = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            width = batch["embedding"].value_lengths()
            for w, rows in _by_width(batch["embedding"]):
                (h1, m1), (h2, m2) = (moves(x, b) for x, b in zip(_halves(_matrix(batch["embedding"], rows, w), books[0].shape[1]), books, strict=True))
                homes[rows] = h1 * side + h2
                for k, (i, j) in zip(rows.tolist(), staircase(m1, m2, most), strict=True):
                    cells = i * side + j
                    visits[k] = cells[cells != homes[k]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["class"], batch["label"], batch["embedding"], batch["weight"], width.cast(pa.int32()), pa.array(homes), pa.array(visits, pa.list_(pa.int32()))], schema=schema)

    return run


def _linked(s: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines are large enough; next to the threshold they are summed anew without rounding between."""
    out = s >= threshold
    for i, j in zip(*np.nonzero(np.abs(s - threshold) < 1e-12), strict=True):
        dot, p, q = (math.fsum((x * y).tolist()) for x, y in ((a[i], b[j]), (a[i], a[i]), (b[j], b[j])))
        out[i, j] = dot / math.sqrt(p * q) >= threshold
    return out


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(block: dict, threshold: float) -> list[tuple[int, int, int]]:
    """class, links and hub of the linked members of one block."""
    x, kind, mine, home = block["x"], block["kind"], block["mine"], block["home"]
    if kind == 0:  # residents with residents: of one part among themselves, or of two parts
        a = np.flatnonzero(mine == mine.min())
        b = np.flatnonzero(mine == mine.max())
        hit = _linked(x[a] @ x[b].T, x[a], x[b], threshold)
        if mine.min() == mine.max():
            if block["across"]:
                return []
            hit = np.triu(hit, 1)
        i, j = (r[c] for r, c in zip((a, b), np.nonzero(hit), strict=True))
    else:  # residents with visitors
        a, b = np.flatnonzero(block["visitor"] == 0), np.flatnonzero(block["visitor"] == 1)
        i, j = (r[c] for r, c in zip((a, b), np.nonzero(_linked(x[a] @ x[b].T, x[a], x[b], threshold)), strict=True))
        again = np.array([home[q] < block["cell"] and home[q] in block["visits"][p] for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[~again], j[~again]
    links = np.zeros(len(x), np.int64)
    np.add.at(links, i, block["weight"][j])
    np.add.at(links, j, block["weight"][i])
    root = spanning(len(x), i, j)
    some = np.flatnonzero(links)
    return list(zip(block["class"][some].tolist(), links[some].tolist(), block["class"][root[some]].tolist(), strict=True))


def _blocks(threshold: float):
    """Rows come sorted by block; a block has about 2 * BLOCK rows at most."""
    names = ("label", "width", "cell", "kind", "p", "q")

    def solve(now: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        col = lambda c: t[c].to_numpy()
        vectors = t["embedding"].chunk(0)
        block = {c: col(c) for c in ("class", "weight", "visitor", "mine", "home")} | {"cell": now[2], "kind": now[3], "across": now[4] != now[5]}
        block |= {"x": _matrix(vectors, np.arange(t.num_rows), now[1]), "visits": [set(v or ()) for v in t["visits"].to_pylist()]}
        out = _compare(block, threshold)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[], [], []])], schema=_LINKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in names), strict=True))
            at = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[at]:
                    continue
                if keys[at] != now:
                    if held:
                        yield solve(now, held)
                    now, held = keys[at], []
                held.append(batch.slice(at, k - at))
                at = k
        if held:
            yield solve(now, held)

    return run


def _grid(spark: SparkSession, classes: DataFrame, threshold: float, recall: float):
    """Codebooks and radius, broadcast."""
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k = min(GRID[1], max(GRID[0], 1 << math.ceil(math.log2(max(1.0, math.sqrt(most / RESIDENTS))))))
    chosen = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, rows in _by_width(batch["embedding"]):
                yield pa.RecordBatch.from_arrays([pa.array([w] * len(rows), pa.int32()), *[pa.array(list(x.astype(np.float32))) for x in _halves(_matrix(batch["embedding"], rows, w))]], ["width", "a", "b"])

    found = chosen.mapInArrow(halves, "width int, a array<float>, b array<float>").toArrow()
    widths = found["width"].to_numpy()
    size = int(min(WIDE, max(1, (widths.max(initial=1) + 1) // 2)))
    parts = [found[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDE)[:, :size].astype(np.float64) for c in ("a", "b")]
    rng = np.random.default_rng(11)
    books = [codebook(x, k, rng) for x in parts] if len(widths) else [np.zeros((1, size))] * 2
    return spark.sparkContext.broadcast((books, radius(books, parts, widths.astype(np.float64), threshold, recall)))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id long, embedding, label).

    n_links: other vectors of the label at that cosine or above; component_id: the smallest id reachable by links. recall: the
    least part of the pairs at just the threshold that are to meet; with 1 all are found.
    """
    spark = rows.sparkSession
    lean(spark)
    rows = rows.select("vec_id", "label", "embedding")
    valid = rows.where(comparable(F.col("label"), F.col("embedding")))
    classes = valid.groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    shared = _grid(spark, classes, threshold, recall)
    schema = _INDEXED.format(**kinds)
    arrow = classes.select("class", "label", "embedding", "weight").limit(0).toArrow().schema
    arrow = pa.schema([*arrow, ("width", pa.int32()), ("home", pa.int32()), ("visits", pa.list_(pa.int32()))])
    spread = classes.select("class", "label", "embedding", "weight").repartition(max(shuffle_width(spark), classes.count() // 20_000), "class")
    indexed = cut(spread.mapInArrow(_index(shared, arrow), schema), "indexed")

    cell = ["label", "width", "cell"]
    residents = indexed.select("*", F.col("home").alias("cell"), F.lit(0).alias("visitor"))
    visitors = indexed.select("*", F.explode("visits").alias("cell"), F.lit(1).alias("visitor")).withColumn("visits", F.lit(None).cast("array<int>"))
    count = lambda v: F.ceil(F.count_if(F.col("visitor") == v) / BLOCK).cast("int")
    sizes = residents.select(*cell, "visitor").unionByName(visitors.select(*cell, "visitor")).groupBy(*cell).agg(count(0).alias("inner"), count(1).alias("outer"), F.count("*").alias("n")).where("inner > 0 and n > 1").drop("n")
    x = residents.unionByName(visitors).join(sizes, cell)
    x = x.withColumn("mine", F.pmod(F.xxhash64("class"), F.when(F.col("visitor") == 1, F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    to = lambda c, f: F.transform(F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>")), f)
    key = lambda kind, p, q: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))
    of_resident = F.concat(to("inner", lambda k: key(0, F.least("mine", k), F.greatest("mine", k))), to("outer", lambda k: key(1, F.col("mine"), k)))
    of_visitor = to("inner", lambda k: key(1, k, F.col("mine")))
    x = x.withColumn("key", F.explode(F.when(F.col("visitor") == 1, of_visitor).otherwise(of_resident)))
    x = x.select(*cell, "key.kind", "key.p", "key.q", "class", "weight", "visitor", "mine", "home", "visits", "embedding")
    block = [*cell, "kind", "p", "q"]
    met = x.repartition(shuffle_width(spark), *block).sortWithinPartitions(*block).mapInArrow(_blocks(threshold), "class long, links long, hub long")
    met = cut(met, "links")

    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    found = connected_components(met.where("class != hub").select(F.col("class").alias("a"), F.col("hub").alias("b")))
    of = classes.select("class", "least").join(found.withColumnRenamed("node", "class"), "class")
    salt = F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")
    ids = of.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = of.select("class", "component", salt.alias("salt")).join(ids, ["component", "salt"]).select("class", "component_id")
    known = classes.join(links, "class", "left").join(named, "class", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(known, ["label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
