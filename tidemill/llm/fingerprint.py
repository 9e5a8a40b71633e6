"""Document fingerprints: improbable-feature digests.

Method: every window of 64 bytes gets its Shannon entropy, updated from window to window by the counts of the leaving and
the entering byte (whole numbers, so the place of a text in a batch cannot change it). How often each of 1024 entropy
levels occurs in the whole corpus ranks them: the rarer, the better. In every run of 64 windows the best one wins, the
leftmost on ties; windows that win 16 runs or more are the features. They go into Bloom filters of 2048 bits, 5 bits a
feature, 160 features a filter, chained as long as there are features. Likeness is the bit overlap of each filter of the
shorter chain with its best partner, less the overlap of chance, over the largest possible one, averaged by features.

A text's neighbour in the order of descending ids comes from a range partitioning of the rows; only the first row of each
range is doubled for the range before it.

Edge cases: null texts are empty. Texts of under 64 bytes are one feature, empty ones none: fingerprint ''. Equal
fingerprints have likeness 1, an empty one and another 0. Rows with equal ids follow each other in the order of their
texts; null ids come last. Rows of one id, or of null ids, lie in one range, so in one task. A single row is its own next document. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_hashes, documents, records, shuffle_width, small, window_hashes

WINDOW, RUN, VOTES = 64, 64, 16
LEVELS = 1024
FILTER_BITS, PER_FEATURE, MOST = 2048, 5, 160
PAD = bytes(WINDOW + RUN)

_C = np.arange(WINDOW + 2, dtype=np.float64)
#: c*log2(c) in whole 2^-20 parts
_PLOGP = np.round(_C * np.log2(np.maximum(_C, 1)) * (1 << 20)).astype(np.int64)
_UP = np.diff(_PLOGP)

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def window_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each byte."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    change = _UP[before[WINDOW:]] - _UP[after[: n - 1]]
    sums = np.empty(n, np.int64)
    sums[0] = _PLOGP[np.bincount(data[:WINDOW])].sum()
    np.cumsum(change, out=sums[1:])
    sums[1:] += sums[0]
    return (_PLOGP[WINDOW] - sums) * (LEVELS - 1) // _PLOGP[WINDOW]


def _blobs(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of 64 bytes or more, set apart by padding: the texts' numbers, starts, lengths and all bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if len(t) >= WINDOW:
            held.append(i)
            size += len(t)
        if held and (size > limit or i == len(texts) - 1):
            lengths = np.array([len(texts[k]) for k in held])
            starts = len(PAD) + np.concatenate(([0], np.cumsum(lengths + len(PAD))[:-1]))
            yield held, starts, lengths, np.frombuffer(PAD + b"".join(texts[k] + PAD for k in held), np.uint8)
            held, size = [], 0
    if held:
        lengths = np.array([len(texts[k]) for k in held])
        starts = len(PAD) + np.concatenate(([0], np.cumsum(lengths + len(PAD))[:-1]))
        yield held, starts, lengths, np.frombuffer(PAD + b"".join(texts[k] + PAD for k in held), np.uint8)


def _inside(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[starts + lengths - WINDOW + 1] -= 1
    return np.cumsum(edge[:-1]).astype(bool)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS, np.int64)
    for batch in small(batches):
        for _, starts, lengths, data in _blobs([(t or "").encode() for t in batch["text"].to_pylist()]):
            levels = window_levels(data)
            total += np.bincount(levels[_inside(starts, lengths, len(levels))], minlength=LEVELS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], names=["level", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level, 0 for the rarest, from all windows of all texts."""
    counted = docs.select("text").mapInArrow(_histogram, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS, np.int64)
    for r in counted:
        n[r["level"]] = r["n"]
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    return rank


class Digest:
    """A chain of filters with the features in each."""

    def __init__(self, features: np.ndarray):
        self.filters, self.counts = [], []
        for k in range(0, len(features), MOST):
            part = features[k : k + MOST]
            spots = (part[:, None] >> (np.arange(PER_FEATURE, dtype=np.uint64) * np.uint64(11)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            bits = np.zeros(FILTER_BITS, np.uint8)
            bits[spots.ravel()] = 1
            self.filters.append(np.packbits(bits).view(np.uint64))
            self.counts.append(len(part))
        self.sizes = [int(np.bitwise_count(f).sum()) for f in self.filters]

    def __str__(self) -> str:
        return "-".join(f"{n}.{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(self.counts, self.filters, strict=True))


def likeness(a: Digest, b: Digest) -> float:
    if len(a.filters) > len(b.filters):
        a, b = b, a
    if not a.filters:
        return 1.0 if not b.filters else 0.0
    others = np.array(b.filters)
    total = 0.0
    for f, size, n in zip(a.filters, a.sizes, a.counts, strict=True):
        common = np.bitwise_count(others & f).sum(axis=1, dtype=np.int64)
        sizes = np.array(b.sizes)
        chance, most = size * sizes / FILTER_BITS, np.minimum(size, sizes)
        total += n * float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / sum(a.counts)


def digests(rank: np.ndarray, texts: list[bytes]) -> list[Digest]:
    found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for held, starts, lengths, data in _blobs(texts):
        levels = window_levels(data)
        inside = _inside(starts, lengths, len(levels))
        key = (np.where(inside, rank[levels], LEVELS) << 40) | np.arange(len(levels))
        low, reach = key, 1
        while reach < RUN:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        votes = np.bincount(low & ((1 << 40) - 1), minlength=len(levels))
        at = np.flatnonzero(inside & (votes >= VOTES))
        hashes = window_hashes(data, at)
        cut = np.searchsorted(at, starts)
        for k, a, b in zip(held, cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
            own = hashes[a:b]
            found[k] = own[np.sort(np.unique(own, return_index=True)[1])]
    for k, t in enumerate(texts):
        if 0 < len(t) < WINDOW or (t and not len(found[k])):
            data = np.frombuffer(t, np.uint8)
            found[k] = byte_hashes(data, np.array([0]), np.array([len(t)]))
    return [Digest(f) for f in found]


def with_next(docs: DataFrame) -> DataFrame:
    """part, last (a row that only follows the part's own), doc_id, text: parts sorted by descending id within partitions."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"))
    parts = 4 * width
    bounds = x.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    bounds = sorted(set(bounds or []))
    of = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col("at")))
    x = x.withColumn("part", of)
    first = sorted((r["part"], r["top"]) for r in x.groupBy("part").agg(F.max("at").alias("top")).collect())  # a row a range
    before = {top: first[(k + 1) % len(first)][0] for k, (_, top) in enumerate(first)}
    where = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col("at")) if before else F.lit(None).cast("int")
    x = x.withColumn("also", where)
    x = x.withColumn("to", F.explode(F.when(F.col("also").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("last")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("last")), F.struct(F.col("also").alias("part"), F.lit(True).alias("last"))))))
    x = x.select("to.part", "to.last", "doc_id", "at", "text").repartition(width, "part")
    return x.sortWithinPartitions("part", "last", F.col("at").desc(), "text").select("part", "last", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    rank = docs.sparkSession.sparkContext.broadcast(rarity(docs))

    def solve(held: list[tuple]) -> pa.RecordBatch:
        """held: (id, text, next text); a next text mostly is the text that follows."""
        texts, of_next = [], []
        for k, (_, text, after) in enumerate(held):
            texts.append(text)
            if k + 1 < len(held) and held[k + 1][1] is after:
                of_next.append(None)
            else:
                of_next.append(after)
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in held]
        extra = [n for n in of_next if n is not None]
        coded = [e.encode() for e in edited]
        all_ = digests(rank.value, [t.encode() for t in texts] + coded + [n.encode() for n in extra])
        own, changed, rest = all_[: len(held)], all_[len(held) : 2 * len(held)], iter(all_[2 * len(held) :])
        out: list[list] = [[] for _ in _RESULT.names]
        for k, (doc_id, text, _) in enumerate(held):
            after = own[k + 1] if of_next[k] is None else next(rest)
            row = (doc_id, len(text), hashlib.sha256(coded[k]).hexdigest(), str(own[k]), str(changed[k]), likeness(own[k], changed[k]), likeness(own[k], after))
            for column, v in zip(out, row, strict=True):
                column.append(v)
        return records(_RESULT, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, size, done = None, [], 0, None
        for batch in small(batches):
            for part, last, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "last", "doc_id", "text")), strict=True):
                if last and done == part:
                    continue
                if waiting is not None:
                    held.append((*waiting, text))
                    size += len(text)
                waiting, done = (None, part) if last else ((doc_id, text), None)
                if size > 500_000:
                    yield solve(held)
                    held, size = [], 0
        if held:
            yield solve(held)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, kinds)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
