"""Spelling variant grouping by full neighbourhood generation.

Method: for each word of the vocabulary all distinct strings at one deletion, replacement or insertion over the observed
alphabet are made, and a hash join of these candidates with the vocabulary gives the near words; no distance is measured.
A word of length L over an alphabet of A letters has at most L + L * (A - 1) + (L + 1) * A - L candidates.

Most candidates are no words. The hash of a string is a sum of one random number for each letter at its place, so running
sums of the word, of the word moved one place left and of the word moved one place right give the hashes of all candidates,
and a bounded Bloom filter of the vocabulary's hashes sieves them before any string is made. What passes is joined by the
strings themselves: the filter can only pass too much.

Counting words adds up within a text and a batch first, so a very common word is one row a batch. A word's candidates are
bounded by its length and the alphabet, so no join key is hot. Roots are found by doubling: a form has at least FACTOR times
the count of its word, so the chains, and the rounds, grow with the logarithm of the largest count at most.

Edge cases: null texts have no words. A null id counts as the empty text in the hash. Rows with equal ids or texts count
each. A word has no near words where it is alone: form null, root itself, n_near 0. Among near words of equal count the
smallest in code-point order is the form. An empty table, or one without words that are frequent and long enough, gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, key_filter, mix64, passes, records, shuffle_width, small

#: Letters after A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
SLIP = 199
LENGTH, COUNT, FACTOR = 6, 5, 5
#: Characters of a text that are cut into words at once; distinct words held by a task before they are passed on.
PART, HELD = 1 << 20, 200_000
#: Words whose candidates are made in one task.
TASK = 10_000
#: The sieve has 64 places for each word, within these powers of two (8 and 64 MB).
LEAST_BITS, MOST_BITS = 26, 29

_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_CANDIDATES = pa.schema([("word", pa.string()), ("n", pa.int64()), ("candidate", pa.string())])


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, cut where no run is."""
    at = 0
    while len(text) - at > PART:
        rest = RUN.match(text, at + PART)
        end = rest.end() if rest else at + PART
        yield text[at:end]
        at = end
    yield text[at:]


def slipped(doc_id: str, run: str) -> str:
    """The run, with a letter left out where the hash of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in small(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                name = "" if doc_id is None else str(doc_id)
                for part in _parts((text or "").encode().lower().decode()):  # of bytes, so only A-Z
                    for word, n in Counter(RUN.findall(part)).items():
                        if len(word) >= length:
                            held[slipped(name, word)] += n
                if len(held) > HELD:
                    yield records(_COUNTED, [list(held), list(held.values())])
                    held.clear()
        yield records(_COUNTED, [list(held), list(held.values())])

    return run


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """word, n of the words of docs (doc_id, text) of at least that many letters and occurrences."""
    counted = docs.select("doc_id", "text").mapInArrow(_count(length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= length) & (F.col("n") >= count))


def _at(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The random number of a letter at a place."""
    return mix64(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(letter.astype(np.uint64) + np.uint64(0xD1342543DE82EF95)))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((len(x), 1), np.uint64), np.cumsum(x, axis=1, dtype=np.uint64)), axis=1)


def _finish(total: np.ndarray, length: int) -> np.ndarray:
    return mix64(total + np.uint64(length * 0xA24BAED4963EE407 & (1 << 64) - 1))


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words of one length."""
    w = _letters(words)
    return _finish(_at(np.arange(w.shape[1])[None, :], w).sum(axis=1, dtype=np.uint64), w.shape[1])


def neighbourhoods(words: list[str], alphabet: np.ndarray, block: int = 1 << 18) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Kind, hashes, words (their numbers), places and letters of all distinct strings at one edit from words of one length.

    Of equal strings one is made: a run of one letter loses its first, and a letter is inserted before a run of itself, not
    within or after it. Places are taken in blocks, so memory is bounded by block and the words.
    """
    w, a = _letters(words), alphabet.astype(np.uint64)
    m, n = w.shape
    own, left, right = (_sums(_at(np.arange(n)[None, :] + k, w)) for k in (0, -1, 1))
    first = np.ones((m, n), bool)
    first[:, 1:] = w[:, 1:] != w[:, :-1]
    i, p = np.nonzero(first)
    yield "delete", _finish(own[i, p] + left[i, n] - left[i, p + 1], n - 1), i, p, np.zeros(len(i), np.uint64)
    step = max(1, block // (m * len(a)))
    for lo in range(0, n + 1, step):
        p = np.arange(lo, min(lo + step, n + 1))
        q = p[p < n]
        new = _at(p[:, None], a[None, :])
        i, j, c = np.nonzero(w[:, q, None] != a)
        yield "replace", _finish((own[:, n :] - own[:, q + 1] + own[:, q])[i, j] + new[j, c], n), i, q[j], a[c]
        before = np.where(p > 0, w[:, np.maximum(p, 1) - 1], 0)
        i, j, c = np.nonzero(before[:, :, None] != a)
        yield "insert", _finish((own[:, p] + right[:, n :] - right[:, p])[i, j] + new[j, c], n + 1), i, p[j], a[c]


def edited(word: str, kind: str, place: int, letter: int) -> str:
    return word[:place] + ("" if kind == "delete" else chr(letter)) + word[place + (kind != "insert") :]


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words of each length."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size).tolist():
        yield np.flatnonzero(size == n).tolist()


def _propose(sieve, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            words, counts, out = batch["word"].to_pylist(), batch["n"].to_pylist(), []
            for rows in _by_length(words):
                for kind, hashes, of, places, letters in neighbourhoods([words[k] for k in rows], alphabet):
                    hit = np.flatnonzero(passes(sieve.value, hashes))
                    for i, p, c in zip(of[hit].tolist(), places[hit].tolist(), letters[hit].tolist(), strict=True):
                        out.append((words[rows[i]], counts[rows[i]], edited(words[rows[i]], kind, p, c)))
            yield records(_CANDIDATES, list(zip(*out, strict=True)) if out else [[], [], []])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        words = batch["word"].to_pylist()
        keys = [word_hashes([words[k] for k in rows]) for rows in _by_length(words)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64))], ["key"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every word of words (word, n; each once) with every other one at one edit, from both sides."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().toArrow()["c"].to_pylist()  # at most the 90 letters of RUN
    alphabet = np.array(sorted(map(ord, letters)), np.uint64)
    many = words.count()
    bits = min(MOST_BITS, max(LEAST_BITS, many.bit_length() + 6))
    sieve = spark.sparkContext.broadcast(key_filter(words.mapInArrow(_hashed, "key long"), "key", bits))
    dealt = words.repartition(max(shuffle_width(spark), many // TASK), "word")  # a small table, but each row is hundreds of candidates
    candidates = dealt.mapInArrow(_propose(sieve, alphabet), "word string, n long, candidate string")
    return candidates.join(words.select(F.col("word").alias("candidate"), F.col("n").alias("near_n")), "candidate").select("word", "n", F.col("candidate").alias("near"), "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form; forms: word, form."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = cut(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = further.select("word", "root")
        if further.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, length: int = LENGTH, count: int = COUNT, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of the frequent words of docs (doc_id, text).

    form: the near word with the largest count, if that is at least factor times the word's own; root: the end of the chain
    of forms.
    """
    words = cut(vocabulary(docs, length, count), "vocabulary")
    pick = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), pick.alias("best"))
    near = cut(best.select("word", "n_near", F.when(-F.col("best.minus") >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("chosen")), "near").select("word", "n_near", "chosen.*")
    roots = _roots(near.where("form is not null").select("word", "form"))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))
