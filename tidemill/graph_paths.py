"""Whole-graph algorithms on an adjacency (src, dst, ...): shortest paths, PageRank and components.

Each runs in rounds of joins and aggregates; a round's result is written to the shared folder and read again, so lineage
stays short and a lost executor costs one round at most. No node or edge reaches the driver, only counts and sums.

PageRank has its own tables, of blocks of nodes. For the others: a hub is a node with over HUB edges: its edges are dealt over
parts by a hash of their far end, and what a round sends along them is repeated once for each part, so no task gets all edges of
one node. The few nodes that share a hub's bucket, in which edges are counted, are dealt alike. What comes in at a node is summed where it is
made before it is shuffled. Tables with a row for each node are joined by merging: their files are so small that Spark would
broadcast millions of rows. The far ends of a node or part are one row of a table in buckets, so no round shuffles edges.

Nodes may be numbers in place of names, which makes all rows shorter; name then gives the column that they are ordered by.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .kept import cut
from .sources import adjacency

HUB, LEAST_BUCKETS, BUCKET_EDGES = 200_000, 12, 1_000_000
#: Of PageRank: blocks of a graph that isn't tiny, nodes of a block, edges of a piece, which a task holds, rows it joins.
LEAST_BLOCKS, BLOCK_NODES, PIECE_EDGES, HELD_ROWS = 24, 2_000_000, 12_000_000, 2_000_000


def itself(node: Column) -> Column:
    return node


def _lists(adj: DataFrame, name: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Edges as (src, part, dsts), parallel ones as often as they are, and what adds the number of their parts to nodes (src).

    Edges are counted in buckets of nodes, eight times as many as there can be hubs. All nodes of a bucket with over HUB edges,
    a hub's, have as many parts as these need; where nodes lie in other buckets, each has one."""
    spark, counted = adj.sparkSession, Observation()
    edges = cut(adj.observe(counted, F.count("*").alias("n")), f"{name}-edges")
    n_edges = counted.get["n"]
    bucket = F.pmod(F.xxhash64("src"), F.lit(8 * n_edges // HUB + 1)).alias("bucket")
    crowded = edges.groupBy(bucket).agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1")
    crowded = cut(crowded, f"{name}-crowded")  # at most one for each HUB edges

    def parted(nodes: DataFrame) -> DataFrame:
        found = nodes.select("*", bucket).join(crowded, "bucket", "left").drop("bucket")
        return found.withColumn("parts", F.coalesce("parts", F.lit(1)))

    n, table = max(LEAST_BUCKETS, n_edges // BUCKET_EDGES), f"{name}_lists_{uuid.uuid4().hex}"
    dealt = parted(edges).select("src", F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part"), "dst").repartition(n, "src", "part")
    lists = dealt.groupBy("src", "part").agg(F.collect_list("dst").alias("dsts"))
    lists.write.bucketBy(n, "src", "part").saveAsTable(table)
    return spark.table(table), parted


def _salted(adj: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges as _lists gives them, and (src, parts) of every node with edges."""
    edges, parted = _lists(adj, name)
    return edges, cut(parted(edges.select("src").distinct()), f"{name}-parts")


def _between(adj: DataFrame, known: DataFrame) -> DataFrame:
    """The edges with both ends among known nodes (src)."""
    ends = [known.select(F.col("src").alias(c)).hint("merge") for c in ("dst", "src")]
    return adj.select("src", "dst").join(ends[0], "dst", "left_semi").join(ends[1], "src", "left_semi")


def _sent(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Every row of state (src, parts, ...) along all edges of its node."""
    dealt = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = dealt.hint("shuffle_hash")  # a bucket has no more nodes than edges, so its part of the state is small
    return dealt.join(edges, ["src", "part"]).withColumn("dst", F.explode("dsts")).drop("dsts")


def shortest_paths(adj: DataFrame, sources: DataFrame, hops: int, each: bool = False, name: Callable[[Column], Column] = itself) -> DataFrame:
    """node, source, dist, path (nodes from source to node) of all nodes within some hops of the sources (node).

    Each node's nearest source, the smallest of several; with each=True, one row for each source within reach. Of several
    shortest paths the one whose last node but one is smallest is taken, and so on back to the source. Null and repeated
    sources count once or not at all; sources without edges, or unknown ones, reach themselves.
    """
    if hops < 0:
        raise ValueError("hops must not be negative")
    key = ["node", "source"] if each else ["node"]
    edges, parted = _lists(adj.select("src", "dst"), "path")
    start = sources.select("node").where("node is not null").distinct()
    layers = [cut(start.select("node", F.col("node").alias("source"), F.lit(0).alias("dist"), F.array("node").alias("path")), "paths")]
    for dist in range(1, hops + 1):
        if dist > 1 and layers[-1].isEmpty():
            break
        state = parted(layers[-1].select(F.col("node").alias("src"), "source", "path"))
        seen = reduce(DataFrame.unionByName, [x.select(*key) for x in layers])
        order = F.struct(name(F.col("source")), name(F.col("src"))).alias("order")
        met = _sent(state.select("*", order), edges).select(F.col("dst").alias("node"), "source", "path", "order")
        best = met.groupBy(*key).agg(F.min_by(F.struct("source", "path"), "order").alias("best"))
        found = best.join(seen, key, "left_anti").select("node", "best.source", F.lit(dist).alias("dist"), F.concat("best.path", F.array("node")).alias("path"))
        layers.append(cut(found, "paths"))
    return reduce(DataFrame.unionByName, layers)


def _spread(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark's hash deals to n partitions, one to each."""
    least = spark.range(100 * n).groupBy(F.expr(f"pmod(hash(id), {n})").alias("p")).agg(F.min("id").alias("id"))
    found = [r.id for r in least.orderBy("p").collect()]
    return found if len(found) == n else list(range(n))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    size = next(k for k in (1, 2, 4, 8) if x.max(initial=0) < 1 << 8 * k)
    return bytes([size]) + x.astype(f"u{size}").tobytes()


def _unpacked(data: pa.BinaryScalar) -> np.ndarray:
    data = data.as_buffer()
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def _planes(x: np.ndarray) -> bytes:
    """Doubles byte by byte: the first bytes of all come together, as they are much alike."""
    return np.ascontiguousarray(x, np.float64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _doubles(data: pa.BinaryScalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(8, -1).T).view(np.float64).ravel()


_CELL = pa.schema([("piece", pa.int64()), ("block", pa.int64()), ("target", pa.int64()), ("gaps", pa.binary()), ("counts", pa.binary()), ("ends", pa.binary())])
_STATE = pa.schema([("block", pa.int64()), ("degree", pa.binary()), ("rank", pa.binary()), ("change", pa.float64()), ("idle", pa.float64())])
_CELL_TYPE = "piece long, block long, target long, gaps binary, counts binary, ends binary"
_STATE_TYPE = "block long, degree binary, rank binary, change double, idle double"


def _cells(blocks: list[int], owner: dict[int, int], width: int):
    """From the nodes of a piece (piece, src, far: -1 - place) and its edges (far: number of the far end's block times width and
    place in it, n: how many) a row for each block the edges lead to: the gaps between the far ends, sorted, how many edges
    each has, and the places of their near ends. A row with target -1 has the degrees in the piece.

    An edge is one number, its far and near end, so edges are sorted where they lie."""

    def keys(edges: pa.RecordBatch, known: pa.Array) -> np.ndarray:
        near = pc.index_in(edges["src"], value_set=known)
        valid = near.is_valid().to_numpy(zero_copy_only=False)
        return np.repeat(edges["far"].to_numpy()[valid] * width + near.drop_null().to_numpy(), edges["n"].to_numpy()[valid])

    def piece_cells(piece: int, nodes: list[pa.RecordBatch], edges: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(target: int, gaps: bytes, counts: bytes, ends: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_CELL.names, (piece, owner[piece], target, gaps, counts, ends), strict=True))], schema=_CELL)

        own = pa.Table.from_batches(nodes, schema=(nodes or edges)[0].schema).combine_chunks()
        known = own["src"].take(pa.array(np.argsort(-own["far"].to_numpy()))).combine_chunks()
        found = [np.zeros(0, np.int64)]
        while edges:
            found.append(keys(edges.pop(), known))
        key = np.concatenate(found)
        del found
        key.sort()
        bounds = np.searchsorted(key, np.arange(len(blocks) + 1) * width * width).tolist()
        degree = np.zeros(len(known), np.int64)
        for target, a, b in zip(blocks, bounds[:-1], bounds[1:], strict=True):
            if a < b:
                far, near = np.divmod(key[a:b], width)
                degree += np.bincount(near, minlength=len(known))
                first = np.flatnonzero(np.diff(far, prepend=-1))
                yield row(target, _packed(np.diff(far[first] % width, prepend=0)), _packed(np.diff(first, append=b - a)), _packed(near))
        yield row(-1, b"", b"", _packed(degree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, edges = _Held(), _Held()
        for batch in batches:
            pieces, far = batch["piece"].to_numpy(), batch["far"].to_numpy()
            for piece in np.unique(pieces).tolist():
                for held, of in ((nodes, far < 0), (edges, far >= 0)):
                    held.add(piece, batch.select(["src", "far", "n"]).filter(pa.array(of & (pieces == piece))))
        for piece in sorted({*nodes.pieces(), *edges.pieces()}):
            yield from piece_cells(piece, nodes.take(piece), edges.take(piece))

    return run


class _Held:
    """The rows of pieces, in batches of some size however small they come."""

    def __init__(self) -> None:
        self.whole: dict[int, list[pa.RecordBatch]] = {}
        self.small: dict[int, list[pa.RecordBatch]] = {}
        self.waiting: dict[int, int] = {}

    def add(self, piece: int, rows: pa.RecordBatch) -> None:
        if rows.num_rows:
            self.small.setdefault(piece, []).append(rows)
            self.waiting[piece] = self.waiting.get(piece, 0) + rows.num_rows
            if self.waiting[piece] >= HELD_ROWS:
                self.close(piece)

    def close(self, piece: int) -> None:
        small = self.small.pop(piece, [])
        self.waiting.pop(piece, None)
        if small:
            self.whole.setdefault(piece, []).extend(pa.Table.from_batches(small).combine_chunks().to_batches())

    def pieces(self) -> set[int]:
        return {*self.whole, *self.small}

    def take(self, piece: int) -> list[pa.RecordBatch]:
        self.close(piece)
        return self.whole.pop(piece, [])


def _first_state(degrees: pa.Table) -> pa.Table:
    degree = sum(_unpacked(x).astype(np.int64) for x in degrees["ends"])
    return pa.Table.from_pylist([{"block": degrees["block"][0].as_py(), "degree": _packed(degree), "rank": _planes(np.ones(len(degree))), "change": 0.0, "idle": float((degree == 0).sum())}], schema=_STATE)


def _send(state: pa.Table, cells: pa.Table) -> pa.Table:
    """What the nodes of a piece's block give to the far ends of its edges, summed for each far end."""
    share, sums = _doubles(state["rank"][0]) / np.maximum(_unpacked(state["degree"][0]), 1), []
    for counts, ends in zip(cells["counts"], cells["ends"], strict=True):
        counts = _unpacked(counts).astype(np.int64)
        sums.append(_planes(np.add.reduceat(share[_unpacked(ends)], np.cumsum(counts) - counts)))
    return pa.table({"target": cells["target"], "gaps": cells["gaps"], "sums": pa.array(sums, pa.binary())})


def _receive(damping: float, idle: float):
    """The new ranks of a block from what was sent to it; idle is what every node gets from those without edges."""

    def run(sent: pa.Table, state: pa.Table) -> pa.Table:
        old, degree = _doubles(state["rank"][0]), _unpacked(state["degree"][0])
        got = np.zeros(len(old))
        for gaps, sums in zip(sent["gaps"], sent["sums"], strict=True):
            got[np.cumsum(_unpacked(gaps), dtype=np.int64)] += _doubles(sums)
        new = 1 - damping + damping * (got + idle)
        row = (state["block"][0].as_py(), state["degree"][0].as_py(), _planes(new), np.abs(new - old).sum(), new[degree == 0].sum())
        return pa.Table.from_pylist([dict(zip(_STATE.names, row, strict=True))], schema=_STATE)

    return run


def _named(n: int):
    def run(nodes: pa.Table, state: pa.Table) -> pa.Table:
        return pa.table({"node": nodes["src"], "rank": pa.array(_doubles(state["rank"][0])[nodes["pos"].to_numpy()] / n)})

    return run


def pagerank(adj: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, least_change: float = 0.0) -> DataFrame:
    """node, rank of all nodes (id); ranks sum to 1.

    A node gives its rank to its neighbours by their number of edges; one without edges gives to all nodes alike. It ends after
    so many rounds, or when the ranks change by no more than least_change in sum. Edges from or to unknown nodes don't count.
    In place of an adjacency (src, dst) it takes edges to be gone both ways (source, target); n says how many a row stands for.

    Nodes are dealt over blocks by a hash and have places there; the edges from a block are one piece, or several, dealt by a
    hash of the far end, if they are too many for a task. The ranks of a block are one row, and what a piece gives to a block
    is one row as well, with one sum for each far end, so a round shuffles some 9 bytes for each piece and far end that meet.
    """
    spark = adj.sparkSession
    ends, n = ("src", "dst") if "src" in adj.columns else ("source", "target"), nodes.count()
    edges = adjacency(cut(adj.select(*ends, (F.col("n") if "n" in adj.columns else F.lit(1)).cast("int").alias("n")), "rank-edges")).select("src", "dst", "n")
    n_edges = edges.count()
    n_blocks = max(1, min(LEAST_BLOCKS, n // 10_000), n // BLOCK_NODES, n_edges // PIECE_EDGES)
    blocks = _spread(spark, n_blocks)
    place = F.pmod(F.xxhash64("src"), F.lit(n_blocks)).cast("int")
    known = nodes.select(F.col("id").alias("src")).where("src is not null").select(F.lit(blocks)[place].cast("long").alias("block"), "src")
    in_block = Window.partitionBy("block").orderBy("src")
    numbers = cut(known.repartition(n_blocks, "block").distinct().withColumn("pos", F.row_number().over(in_block) - 1), "rank-nodes")
    n, width = numbers.agg(F.count("*"), F.max("pos") + 1).first()
    if not n:
        return numbers.select(F.col("src").alias("node"), F.lit(0.0).alias("rank"))

    counts = dict(edges.groupBy(place.alias("place")).count().collect())
    parts = [max(1, round(counts.get(k, 0) / PIECE_EDGES)) for k in range(n_blocks)]
    starts = [sum(parts[:k]) for k in range(n_blocks)]
    pieces = _spread(spark, sum(parts))
    owner = {pieces[start + j]: block for block, start, m in zip(blocks, starts, parts, strict=True) for j in range(m)}
    piece = lambda part: F.lit(pieces)[(F.lit(starts)[place] + part).cast("int")].cast("long").alias("piece")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 500_000, n_edges // 4_000_000)
    far = (place.cast("long") * width + F.col("pos")).alias("far")
    ends = numbers.select(far, F.col("src").alias("dst")).repartition(tasks, "dst").hint("shuffle_hash")
    met = edges.repartition(tasks, "dst").join(ends, "dst").select(piece(F.pmod(F.xxhash64("dst"), F.lit(parts)[place])), "src", "far", "n")
    own = numbers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts)[place] - 1))).select(piece(F.col("part")), "src", (-1 - F.col("pos")).cast("long").alias("far"), F.lit(0).alias("n"))
    table = f"rank_cells_{uuid.uuid4().hex}"
    cells = met.unionByName(own).repartition(len(pieces), "piece").mapInArrow(_cells(blocks, owner, width), _CELL_TYPE)
    cells.write.bucketBy(len(pieces), "piece").saveAsTable(table)
    cells = spark.table(table)

    state = cut(cells.where("target < 0").select("block", "ends").groupBy("block").applyInArrow(_first_state, _STATE_TYPE), "ranks")
    cells = cells.where("target >= 0").select("piece", "target", "gaps", "counts", "ends").groupBy("piece")
    dealt = F.create_map(*[x for k, b in enumerate(blocks) for x in (F.lit(b).cast("long"), F.lit(pieces[starts[k] : starts[k] + parts[k]]).cast("array<long>"))])
    for _ in range(rounds):
        idle = state.agg(F.sum("idle")).first()[0]
        blocked = state.select("block", "degree", "rank").repartition(n_blocks, "block")
        owned = blocked.groupBy("block")  # each block one piece of the same number, so its row is shuffled once
        if pieces != blocks:
            owned = state.select(F.explode(dealt[F.col("block")]).alias("piece"), "degree", "rank").repartition(len(pieces), "piece").groupBy("piece")
        sent = owned.cogroup(cells).applyInArrow(_send, "target long, gaps binary, sums binary").repartition(n_blocks, "target").groupBy("target")
        state = cut(sent.cogroup(blocked.groupBy("block")).applyInArrow(_receive(damping, idle / n), _STATE_TYPE), "ranks")
        if state.agg(F.sum("change")).first()[0] <= least_change * n:
            break
    named = numbers.repartition(n_blocks, "block").groupBy("block").cogroup(state.select("block", "rank").repartition(n_blocks, "block").groupBy("block"))
    return named.applyInArrow(_named(n), f"node {numbers.schema['src'].dataType.simpleString()}, rank double")


def components(adj: DataFrame, nodes: DataFrame, name: Callable[[Column], Column] = itself) -> DataFrame:
    """node, component (the smallest node reachable, by name) of all nodes (id).

    Each round takes the smallest label around a node and then that label's own label, so rounds grow with the logarithm of
    the longest path in most graphs; it ends when no label changes.
    """
    known = nodes.select(F.col("id").alias("src")).where("src is not null").distinct()
    edges, parts = _salted(_between(adj, known), "component")
    state = cut(known.join(parts.hint("merge"), "src", "left").withColumn("label", name(F.col("src"))), "components")
    while True:
        around = _sent(state.where("parts is not null").select("src", "parts", "label"), edges).groupBy(F.col("dst").alias("src")).agg(F.min("label").alias("near"))
        low = cut(state.join(around, "src", "left").select("src", "parts", F.col("label").alias("old"), F.least("label", "near").alias("label")), "components")
        jump = low.select(name(F.col("src")).alias("label"), F.col("label").alias("further")).hint("merge")
        state = cut(low.join(jump, "label").select("src", "parts", F.least("label", "further").alias("label"), (F.col("old") != F.least("label", "further")).alias("moved")), "components")
        if state.where("moved").isEmpty():
            return state.select(F.col("src").alias("node"), F.col("label").alias("component"))
        state = state.drop("moved")
