"""Linking a table of texts to named entities: longest name first, a matched stretch is not used again.

Every stretch of a text that is as long as some name gets a hash from running sums, one subtraction and product each, for
all places of a text and one length at a time. A bounded Bloom filter of the first letters of names sieves the places, one of
the longer names what starts there, and what passes is joined with the names by the strings themselves, so the number of
names is not bounded by what a task or a broadcast can hold and the filters can only let too much pass. Candidates leave
Python in batches of some number, however full the filters are. The overlapping matches of one text, no more than it has
places and lengths, are then settled where they meet.

Texts and names are compared in lower case; places count in the lower-cased text. Of entities with one name the last by ord
counts. Empty and null names match nothing, null texts have no matches. Keys of texts are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import cut
from .sources import short_batches

_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
#: Letters of a head: many names begin alike, so places of a text where none begins are told by a small sieve.
HEAD = 8
#: A sieve has 32 places for each name, within these powers of two (1 and 32 MB).
LEAST_BITS, MOST_BITS = 23, 28
#: Candidates a batch that leaves Python holds, but for those of one length in one text.
CANDIDATES = 20_000
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(2 * n, b, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def stretch_hashes(text: str, length: int, sums: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all stretches of that length, or of those at some places; equal strings have equal ones wherever they stand."""
    sums = running_sums(text) if sums is None else sums
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = slice(n) if at is None else at
    return _mixed((sums[length:][at] - sums[at]) * _powers(len(sums))[1][at])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    return x * _SPREAD


def running_sums(text: str) -> np.ndarray:
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * _powers(len(letters) + 1)[0][: len(letters)], dtype=np.uint64)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each name, from the running sums of all names of a batch in a row."""
    for batch in batches:
        names = batch["name"].to_pylist()
        ends = np.cumsum([len(n) for n in names], dtype=np.int64)
        starts, sums = np.concatenate(([0], ends[:-1])).astype(np.int64), running_sums("".join(names))
        keys = _mixed((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def _sieve(names: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter; Spark ORs the bits of a word together, so the driver gets no more rows than it has words."""
    bits = min(MOST_BITS, max(LEAST_BITS, names.count().bit_length() + 5))
    place = F.expr(f"shiftrightunsigned(key, {64 - bits})")
    words = names.select("name").mapInArrow(_hashed, "key long").select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["slot"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def _passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - (len(words).bit_length() - 1 + 6))
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _places(text: str, lengths: list[int], heads: np.ndarray, wholes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """For each length the places of a text where a name of that length may start."""
    sums = running_sums(text)
    begins = np.flatnonzero(_passes(heads, stretch_hashes(text, HEAD, sums)))
    for length in lengths:
        if length <= HEAD:
            at = np.flatnonzero(_passes(heads, stretch_hashes(text, length, sums)))
        else:
            at = begins[begins < len(sums) - length]
            at = at[_passes(wholes, stretch_hashes(text, length, sums, at))]
        yield length, at.tolist()


def _propose(shared, keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, heads, wholes = shared.value
        for batch in batches:
            row, at, name = [], [], []

            def made(batch=batch) -> pa.RecordBatch:
                took = [batch[c].take(pa.array(row, pa.int64())) for c in keys]
                return pa.RecordBatch.from_arrays([*took, pa.array(at, pa.int64()), pa.array(name, pa.string())], schema=schema)

            for k, text in enumerate(batch["_text"].to_pylist()):
                for length, places in _places(text, lengths, heads, wholes):
                    row += [k] * len(places)
                    at += places
                    name += [text[p : p + length] for p in places]
                    if len(row) >= CANDIDATES:
                        yield made()
                        row, at, name = [], [], []
            yield made()

    return run


def _settle(keys: list[str], schema: pa.Schema):
    """Of the matches of each text, longest and leftmost first, those that lie on no stretch taken before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.RecordBatch.from_struct_array(batch["found"].flatten())
            at, length, kept = found["at"].to_numpy(), found["length"].to_numpy(), []
            ends = np.cumsum(batch["found"].value_lengths().to_numpy())
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                taken = bytearray((at[a:b] + length[a:b]).max())
                for m in (a + np.lexsort((at[a:b], -length[a:b]))).tolist():
                    p, q = at[m], at[m] + length[m]
                    if taken.find(1, p, q) < 0:
                        taken[p:q] = b"\1" * (q - p)
                        kept.append(m)
            kept = np.array(kept, np.int64)
            took = [batch[c].take(pa.array(np.searchsorted(ends, kept, "right"))) for c in keys]
            rest = [found[c].take(pa.array(kept)) for c in ("at", "length", "id")]
            yield pa.RecordBatch.from_arrays([*took, *rest], schema=schema)

    return run


def dictionary(entities: DataFrame) -> DataFrame:
    """name (lower case), id of entities (id, name, ord); of one name the last counts."""
    return entities.where("name is not null and name != ''").groupBy(F.lower("name").alias("name")).agg(F.max_by("id", "ord").alias("id"))


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)


def matches(texts: DataFrame, column: str, keys: list[str], entities: DataFrame) -> DataFrame:
    """keys, at, length, name, id of every occurrence of a name in a text, overlapping ones too."""
    spark: SparkSession = texts.sparkSession
    short_batches(spark)
    names = cut(dictionary(entities), "names")
    lengths = sorted(r[0] for r in names.select(F.length("name")).distinct().collect())  # bounded by the longest name
    heads = names.select(F.substring("name", 1, HEAD).alias("name")).distinct()
    shared = spark.sparkContext.broadcast((lengths, _sieve(heads), _sieve(names.where(F.length("name") > HEAD))))
    lowered = texts.where(F.col(column).isNotNull()).select(*keys, F.lower(column).alias("_text"))
    arrow = pa.schema([*lowered.limit(0).toArrow().schema][: len(keys)] + [("at", pa.int64()), ("name", pa.string())])
    candidates = lowered.mapInArrow(_propose(shared, keys, arrow), f"{_kinds(lowered, keys)}, at long, name string")
    candidates = candidates.hint("merge")  # Spark takes them for as large as the texts, but one text has many: never broadcast
    return candidates.join(names, "name").select(*keys, "at", F.length("name").alias("length"), "name", F.col("id").cast("string").alias("id"))


def link(texts: DataFrame, column: str, keys: list[str], entities: DataFrame) -> DataFrame:
    """keys, at, length, id: the entities of each text, longest name first, the leftmost of equal ones, none on another."""
    found = matches(texts, column, keys, entities).groupBy(*keys).agg(F.collect_list(F.struct("at", "length", "id")).alias("found"))
    schema = pa.schema([*found.limit(0).toArrow().schema][: len(keys)] + [("at", pa.int64()), ("length", pa.int32()), ("id", pa.string())])
    return found.mapInArrow(_settle(keys, schema), f"{_kinds(found, keys)}, at long, length int, id string")


def first_entity(texts: DataFrame, column: str, keys: list[str], entities: DataFrame) -> DataFrame:
    """keys, at, length, id: the one entity of each text that has any: the longest name, where it occurs first, the smaller
    name of several equally long."""
    pick = F.min_by(F.struct("at", "length", "id"), F.struct(-F.col("length"), "name", "at"))
    return matches(texts, column, keys, entities).groupBy(*keys).agg(pick.alias("x")).select(*keys, "x.at", "x.length", "x.id")
