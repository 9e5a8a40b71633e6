"""Fill-in-middle transformation by a run-length encoding of character classes.

Method: a text is stored as its maximal runs of one character class, with the units that end in each run and their running
count. A cut after k units is found by binary search for the run that holds unit k; its place in the run is arithmetic:
all units of a run are equally long. With units of "token" (blanks and the word after them, or blanks at the end of a text)
the classes are blank and other, a run of words ends one unit and a run of blanks none, but for the last one. With units
of "char" the classes are the lengths of code points in UTF-8, and a run holds as many units as code points. So no list of
tokens exists, and a text takes memory for its bytes and runs alone.

All choices come from the SHA-256 of seed and id, so each row is made where it is read, without a shuffle, and a task that
runs again gives the same rows.

Edge cases: a null text is empty; an empty text, and one that holds a mark already, stays plain. A null id counts as the
empty text in the hash. Prefix, middle and suffix may each be empty. Rows with equal ids get equal choices, each for its own
number of units. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, records, small

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80
FLUSH = 4 << 20

_MADE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def _edges(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of equal values."""
    at = np.flatnonzero(np.diff(classes)) + 1
    return np.concatenate(([0], at)), np.concatenate((at, [len(classes)]))


def class_runs(data: np.ndarray, unit: str = "token") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of a class in UTF-8 bytes, and the units of each run."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    if unit == "token":
        blank = ((data == 32) | ((data >= 9) & (data <= 13))).view(np.int8)
        starts, ends = _edges(blank)
        units = 1 - blank[starts].astype(np.int64)
        units[-1] = 1
        return starts, ends, units
    if unit == "char":
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(lead, len(data)))
        first, last = _edges(width)
        return lead[first], np.append(lead, len(data))[last], last - first
    raise ValueError(f"unknown unit {unit}")


def place(runs: tuple[np.ndarray, np.ndarray, np.ndarray], upto: np.ndarray, k: int) -> int:
    """The byte after unit k; upto: the running count of units at the end of each run."""
    if k == 0:
        return 0
    starts, ends, units = runs
    r = int(np.searchsorted(upto, k))
    return int(starts[r] + (ends[r] - starts[r]) // units[r] * (k - upto[r] + units[r]))


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def one(doc_id: int | None, text: bytes, seed: int, rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    data = np.frombuffer(text, np.uint8)
    runs = class_runs(data, unit)
    upto = np.cumsum(runs[2])
    n = int(upto[-1]) if len(upto) else 0
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]
    if not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text.decode()
    a, b = (place(runs, upto, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a].decode(), text[a:b].decode(), text[b:].decode()
    lengths = _chars(data[:a]), _chars(data[a:b])
    if h[3] % 100 < spm:
        return n, "spm", *lengths, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", *lengths, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "token") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs (doc_id long, text).

    rate: percent of the texts that are transformed; spm: percent of these that put the suffix first; unit: what cuts lie
    between, "token" or "char".
    """
    class_runs(np.zeros(0, np.uint8), unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            out, size = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                out.append((doc_id, *one(doc_id, (text or "").encode(), seed, rate, spm, unit)))
                size += len(out[-1][-1])
                if size > FLUSH:
                    yield records(_MADE, list(zip(*out, strict=True)))
                    out, size = [], 0
            if out:
                yield records(_MADE, list(zip(*out, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL of the query, by a list of all tokens."""
    number = lambda k: f"cast('0x' || substr(h, {8 * k + 1}, 8) as bigint)"
    join = lambda a, b: f"array_to_string(list_slice(t, {a}, {b}), '')"
    return rf"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
    k as (select *, len(t) as n, {number(0)} % (len(t) + 1) as x, {number(1)} % (len(t) + 1) as y,
      case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or {number(2)} % 100 >= {RATE} then 'plain' when {number(3)} % 100 < {SPM} then 'spm' else 'psm' end as form from d),
    c as (select doc_id, text, cast(n as bigint) as n, form, {join('1', 'least(x, y)')} as p, {join('least(x, y) + 1', 'greatest(x, y)')} as m, {join('greatest(x, y) + 1', 'n')} as s from k)
    select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
      sha256(case form when 'plain' then text when 'spm' then '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m else '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m end) as output_sha256,
      sha256(text) as restored_sha256 from c"""
