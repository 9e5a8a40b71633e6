"""Language identification by language-bitmask n-gram filters.

Method: every 4-gram of letters and word gaps is counted per language over all training rows. A language contains a gram
if it has it twice or more and at least a fifth as often, per gram, as the language that has it most. The grams go into
Bloom filters of 3 hashes, with as many places (2^21 at least) as leave half of them free in the fullest language, that are
sliced by bit: a place is a bitmask over languages, so the AND of three
places gives all languages containing a gram in one look. A document's popcount per language is corrected for the
filter's false positives, which are known from its fill; the largest corrected share decides.

The model takes 16 MB for up to 64 languages, 16 MB more for each further 64, as long as no language has over 484,000
grams; more than 4096 values of lang are an error; beyond that it grows with them (35 to 70 bytes a gram of the fullest language) and none is left out. Counting it is a
shuffle of gram counts, summed up within each task first.

Edge cases: null texts and texts without a letter are `und` with score 0, as is every text if no language was learned.
Null or empty lang values are not learned from. Equal texts get equal answers. Ties go to the language that sorts first.
An empty table gives an empty result; only id, text and, in training, lang are read.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_remainder, cut, documents, mix64, records, small

SIZE = 4
PLACE_BITS, HASHES, FILL = 21, 3, 0.5
LEAST, SHARE = 2, 0.2
MOST = 4096
MODULUS, HELD_OUT = 4, 2

_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


class Model(NamedTuple):
    languages: list[str]
    places: np.ndarray  # words x 2^bits masks, PLACE_BITS at least
    false: np.ndarray  # rate of false positives per language


def place_bits(most: int) -> int:
    """The bits of a place that keep the filter of a language of so many grams at most FILL full."""
    return max(PLACE_BITS, math.ceil(math.log2(max(1, most) * HASHES / -math.log(1 - FILL))))


def shifts(bits: int) -> list[int]:
    """Where the places lie in the 64 bits of a hash: disjoint thirds for 21 bits, overlapping as little as they can beyond."""
    return [k * ((64 - bits) // (HASHES - 1)) for k in range(HASHES)]


_LETTERS: list = []  # filled once a process


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)]))
    return _LETTERS[0]


def grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams of the texts, the first gram of each text, and the letters of each."""
    gap = "\0" * (SIZE - 1)
    lowered = [gap + (t or "").lower() + gap for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=starts[1:])
    letter = _letters()[code]
    edge = np.zeros(len(code), bool)
    for k in range(SIZE - 1):
        edge[starts[:-1] + k] = edge[starts[1:] - 1 - k] = True
    keep = letter | edge | np.concatenate(([False], letter[:-1]))
    at = np.concatenate(([0], np.cumsum(keep)))
    count = np.diff(np.concatenate(([0], np.cumsum(letter)))[starts])
    x = np.where(letter, code, 0)[keep].astype(np.uint64)
    if len(x) < SIZE:
        return np.zeros(0, np.uint64), at[starts], count
    n = len(x) - SIZE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SIZE):
        h = (h << np.uint64(16)) + x[k : k + n] * np.uint64(1 + (k << 20))
    return mix64(h), at[starts], count


def _chunks(texts: list, limit: int = 1 << 19) -> Iterator[tuple[int, list]]:
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t or "") > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield first, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, merged within the task until they are many."""
    sums: dict[str, list] = {}

    def flush():
        for lang, parts in sums.items():
            g, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
            for k in range(0, len(g), 100_000):
                yield records(_COUNTS, [[lang] * len(g[k : k + 100_000]), g[k : k + 100_000].view(np.int64), n[k : k + 100_000]])

    held = 0
    for batch in small(batches, 2000):
        by: dict[str, list] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for _, part in _chunks(texts):
                h, starts, _ = grams(part)
                inside = np.ones(len(h), bool)
                for k in range(1, SIZE):  # grams over the end of a text
                    inside[starts[1:-1] - k] = False
                g, n = np.unique(h[inside], return_counts=True)
                sums.setdefault(lang, []).append((g, n))
                held += len(g)
        if held > 4_000_000:
            yield from flush()
            sums, held = {}, 0
    yield from flush()


def fit(docs: DataFrame) -> Model:
    """Learns from all rows of docs (text, lang)."""
    known = docs.where("text is not null and lang is not null and lang != ''").select("text", "lang")
    counts = cut(known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST + 1).collect()}
    if len(totals) > MOST:
        raise ValueError(f"over {MOST} values of lang: that column holds no languages")
    languages = sorted(totals)
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return Model([], np.zeros((words, 1 << PLACE_BITS), np.uint64), np.zeros(0))
    total = F.create_map(*[F.lit(x) for k in languages for x in (k, float(totals[k]))])
    bit = F.create_map(*[F.lit(x) for k, v in enumerate(languages) for x in (v, k)])
    rate = counts.withColumn("rate", F.col("n") / total[F.col("lang")]).withColumn("bit", bit[F.col("lang")])
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate", "n")).alias("all"))
    held = top.select("gram", F.explode("all").alias("x"), "top").where(f"x.n >= {LEAST} and x.rate >= {SHARE} * top")
    held = cut(held.select(F.col("x.bit").alias("bit"), "gram"), "held")
    bits = place_bits(max((r["count"] for r in held.groupBy("bit").count().collect()), default=0))
    width = 1 << bits
    places = np.zeros((words, width), np.uint64)
    # The places are bits of the hash, so the executors and numpy agree on them.
    spots = held.select("bit", F.explode(F.array(*[F.expr(f"cast(shiftrightunsigned(gram, {k}) & {width - 1} as int)") for k in shifts(bits)])).alias("place"))
    masks = spots.groupBy(F.expr("bit div 64").alias("word"), "place").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toArrow()
    places[masks["word"].to_numpy(), masks["place"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    fill = [np.count_nonzero(places[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / width for k in range(len(languages))]
    return Model(languages, places, np.array(fill) ** HASHES)


def answer(model: Model, texts: list) -> tuple[list[str], list[float]]:
    return judge(model, texts)[:2]


def judge(model: Model, texts: list) -> tuple[list[str], list[float], list[float]]:
    """Language, score, and the lead of the best share over the second one as a part of it, however many languages there are."""
    names, scores, leads = [], [], []
    bits = model.places.shape[1].bit_length() - 1
    for _, part in _chunks(texts):
        h, starts, letters = grams(part)
        n = np.maximum(np.diff(starts) - SIZE + 1, 1)
        if not model.languages or not len(h):
            names += ["und"] * len(part)
            scores += [0.0] * len(part)
            leads += [0.0] * len(part)
            continue
        inside = np.ones(len(h), bool)
        for k in range(1, SIZE):
            inside[starts[1:-1] - k] = False
        spots = [(h >> np.uint64(k) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in shifts(bits)]
        shares = np.empty((len(part), len(model.languages)))
        for word, places in enumerate(model.places):
            mask = np.where(inside, places[spots[0]] & places[spots[1]] & places[spots[2]], np.uint64(0))
            for lang in range(word * 64, min(word * 64 + 64, len(model.languages))):
                hits = np.concatenate(([0], np.cumsum(mask >> np.uint64(lang % 64) & np.uint64(1), dtype=np.int64)))
                ends = np.minimum(starts, len(h))
                seen = (hits[ends[1:]] - hits[ends[:-1]]) / n
                shares[:, lang] = np.clip((seen - model.false[lang]) / max(1e-9, 1 - model.false[lang]), 0, 1)
        best = shares.argmax(axis=1)
        total = shares.sum(axis=1)
        score = np.divide(shares[np.arange(len(part)), best], total, out=np.zeros(len(part)), where=total > 0)
        names += [model.languages[b] if c else "und" for b, c in zip(best.tolist(), letters.tolist(), strict=True)]
        scores += np.where(letters > 0, score, 0.0).tolist()
        first = shares[np.arange(len(part)), best]
        shares[np.arange(len(part)), best] = 0
        lead = np.divide(first - shares.max(axis=1), first, out=np.zeros(len(part)), where=first > 0)
        leads += np.where(letters > 0, lead, 0.0).tolist()
    return names, scores, leads


def identify(docs: DataFrame, model: Model, lead: bool = False) -> DataFrame:
    """docs with the columns lang_pred and score, and lead if wanted, in place of any of these names."""
    extra = ["lang_pred", "score", *(["lead"] if lead else [])]
    docs = docs.drop(*extra)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in small(batches):
            names, *numbers = judge(model, batch["text"].to_pylist())
            made = [pa.array(names, pa.string()), *[pa.array(x, pa.float64()) for x in numbers]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made[: len(extra)]], names=[*batch.schema.names, *extra])

    kinds = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in extra[1:]]]
    return docs.mapInArrow(run, T.StructType(kinds))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_remainder("doc_id", MODULUS) == HELD_OUT
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
