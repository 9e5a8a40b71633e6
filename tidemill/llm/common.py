"""Helpers that several operators share: hashing of words in numpy, bounded key filters, tables cut from lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than blank and the five ASCII controls 9 to 13. bytes.split() cuts exactly there.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 18
FILTER_BITS = 26

PRIME = (1 << 61) - 1
PLACES = 64

_P = np.uint64(PRIME)
_BASE = 0x1B873593CC9E2D51 % PRIME


def lean(spark: SparkSession) -> None:
    """Short Arrow batches for this session: rows hold whole texts, and a batch exists several times at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only on a local master without any."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    lean(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---- numpy hashing -------------------------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the public splitmix64 generator."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _random_table(places: int = PLACES) -> np.ndarray:
    """A fixed random 64-bit number for each place and byte value."""
    return mix64(mix64(np.arange(1, places * 256 + 1, dtype=np.uint64)) ^ np.uint64(0xD1342543DE82EF95))


_TABLE = _random_table()


def _modulo(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, from halves of 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = al * bh + ah * bl
    return _modulo(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + al * bl)


class Powers:
    """Powers of a number and of its inverse modulo PRIME, longer on demand."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            more = [times(x, np.uint64(pow(b, k, PRIME))) for x, b in zip((self.up, self.down), self.bases, strict=True)]
            self.up, self.down = np.concatenate((self.up, more[0])), np.concatenate((self.down, more[1]))
        return self.up, self.down


_POWERS: dict[int, Powers] = {}


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range: a polynomial modulo a prime, from one pass of prefix sums."""
    up, down = _POWERS.setdefault(_BASE, Powers(_BASE)).upto(len(values) + 1)
    x = times(_modulo(values), up[: len(values)])
    sums = np.zeros(len(values) + 1, np.uint64)
    high = np.cumsum(x >> np.uint64(31), dtype=np.uint64)
    high = (high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << np.uint64(31))
    sums[1:] = _modulo(high + np.cumsum(x & np.uint64((1 << 31) - 1), dtype=np.uint64))
    part = times(_modulo(sums[ends] + (_P - sums[starts])), down[starts])
    return mix64(part + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint words of one byte or more: the sum of one random number for each byte at its place.

    Numbers of places beyond the table are mixed from it and the place. Unlike a polynomial modulo 2^64, which all odd
    bases make equal for some long words (Thue-Morse ones), this has no words of such a kind.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    all_ = np.arange(int(sizes.sum()))
    place = all_ - np.repeat(first, sizes)
    x = _TABLE[((place & (PLACES - 1)) << 8) + data[all_ + np.repeat(starts - first, sizes)]]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        x[far] = mix64(x[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix64(np.add.reduceat(x, first) + sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of PLACES bytes that start at the given places; they may overlap."""
    out = np.zeros(len(at), np.uint64)
    for k in range(PLACES):
        out += _TABLE[(k << 8) + data[at + k].astype(np.int64)]
    return mix64(out)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return range_hash(words, at, at + size)


def word_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(words, starts, ends)


def pieces(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Whole texts joined by line ends to blobs of about limit bytes: index of the first text, blob, offsets of all."""
    first, held, size, i = 0, [], 0, -1
    for i, text in enumerate(texts):
        b = (text or "").encode()
        if held and size + len(b) > limit:
            yield _joined(first, held)
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield _joined(first, held)


def _joined(first: int, held: list[bytes]) -> tuple[int, bytes, np.ndarray]:
    offsets = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in held], out=offsets[1:])
    return first, b"\n".join(held), offsets


def small(batches: Iterable[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that few texts at a time exist as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def records(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


# ---- bounded key filters -------------------------------------------------------------------------------------------


def key_filter(df: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A one-hash Bloom filter over the long column key, itself a hash: 2^bits bits (8 MB at 26), whatever the number of keys.

    Only a sieve before an exact join: beyond its capacity more rows pass and are joined, results stay the same. Spark
    ORs the bits of a machine word together, so the driver gets at most 2^(bits-6) rows of 16 bytes.
    """
    place = F.expr(f"shiftrightunsigned({key}, {64 - bits})")
    found = df.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the filter."""
    bits = len(words).bit_length() - 1 + 6
    place = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
