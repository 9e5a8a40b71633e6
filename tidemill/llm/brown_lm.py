"""LM scoring with Brown class-based bigrams.

Method: all training words are counted. The 1024 most frequent ones are put into 48 classes by exchange clustering: each
word in turn moves to the class that raises the class-bigram likelihood most, until few move. Their bigram counts come
from all training texts; the matrix has a fixed size, so one machine can hold it. The words after these follow in two
batches, up to ranks 32768 and 262144: Spark counts, over all training texts, how often the classes known so far stand
before and after each word of the batch, and each word goes to the class to which the exchange step would move it, the
class matrix being held fixed within a batch and filled up after it. A word whose neighbours have no class so far fewer
than 3 times, and levels of count beyond rank 262144, form classes by the magnitude of their count; words seen once and
unknown ones are the tail class, and the end of a text is a class of its own. Then class bigrams are counted over all
training texts again, and

    log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class),

transitions smoothed towards the class frequencies with the weight of 10 observations, words of the tail by adding one to
all counts and to one unknown word. The token before the first is an end.

Frequent words (at most 262144, whatever the corpus) are looked up in a broadcast table; tail words of a text are joined
with the word counts by Spark, so nothing that grows with the vocabulary is sent to all.

Edge cases: a null, empty or wordless text is one token, its end. Without training texts all words are unknown. Rows with
equal ids stay apart; a null id counts as the empty text in the fold rule. Words are compared by 64-bit hashes. An empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_hashes, crc_remainder, cut, documents, pieces, records, small, word_bounds
from .lookup import Lookup, opened

CORE, CLASSES, NEAR, HEAD = 1024, 48, 1 << 15, 1 << 18
LEAST_SEEN = 3
ROUNDS, WEIGHT = 12, 10.0
MODULUS, HELD_OUT = 7, 2
BANDS = 24

_COUNT = pa.schema([("word", pa.int64()), ("n", pa.int64())])


def tokens(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First text, word hashes, number of words before each text and in all, for some texts at a time."""
    for first, blob, offsets in pieces(texts):
        data = np.frombuffer(blob.lower(), np.uint8)
        starts, ends = word_bounds(data)
        yield first, byte_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in small(batches):
        for _, words, _ in tokens(batch["text"].to_pylist()):
            parts.append(np.unique(words, return_counts=True))
            held += len(parts[-1][0])
        if held > 2_000_000:
            parts = [_merge(parts)]
            held = len(parts[0][0])
            if held > 1_000_000:
                for k in range(0, held, 100_000):
                    yield records(_COUNT, [parts[0][0][k : k + 100_000].view(np.int64), parts[0][1][k : k + 100_000]])
                parts, held = [], 0
    if parts:
        keys, n = _merge(parts)
        for k in range(0, len(keys), 100_000):
            yield records(_COUNT, [keys[k : k + 100_000].view(np.int64), n[k : k + 100_000]])


def _with_ends(labels: np.ndarray, before: np.ndarray, end: int) -> np.ndarray:
    """Labels of the words of all texts, an end after each text and before the first."""
    return np.insert(np.concatenate(([end], labels)), before[1:] + 1, end)


def _count_pairs(lookup, labels: np.ndarray, other: int, end: int):
    """Counts of neighbouring labels, as codes left * (end + 1) + right."""
    width = end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        held, size = [], 0
        find, of = opened(lookup), np.append(labels, other)
        for batch in small(batches):
            for _, words, before in tokens(batch["text"].to_pylist()):
                x = _with_ends(of[find(words)], before, end)
                held.append(x[:-1] * width + x[1:])
                size += len(x)
            if size > 1_000_000:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield records(_COUNT, [at[k : k + 100_000], total[at[k : k + 100_000]]])

    return run


def _count_sides(lookup, labels: np.ndarray, classes: int, lo: int, hi: int):
    """For words of rank lo to hi: counts of the classes before (0 to classes) and after (classes + 1 and on) them, as codes
    word * 2 * (classes + 1) + side; the end counts as class number `classes`, words without a class do not count."""
    width = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        find, of = opened(lookup), np.append(labels, -1)
        for batch in small(batches):
            for _, words, before in tokens(batch["text"].to_pylist()):
                at = find(words)
                x, label = _with_ends(at, before, -1), _with_ends(of[at], before, classes)
                new = (x >= lo) & (x < hi)
                right, left = np.flatnonzero(new[1:] & (label[:-1] >= 0)) + 1, np.flatnonzero(new[:-1] & (label[1:] >= 0))
                codes = np.concatenate((x[right] * 2 * width + label[right - 1], x[left] * 2 * width + width + label[left + 1]))
                parts.append(np.unique(codes, return_counts=True))
                held += len(parts[-1][0])
            if held > 1_000_000:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > 500_000:
                    for k in range(0, held, 100_000):
                        yield records(_COUNT, [parts[0][0][k : k + 100_000], parts[0][1][k : k + 100_000]])
                    parts, held = [], 0
        if parts:
            codes, n = _merge(parts)
            for k in range(0, len(codes), 100_000):
                yield records(_COUNT, [codes[k : k + 100_000], n[k : k + 100_000]])

    return run


def gains(grid: np.ndarray, before: np.ndarray, after: np.ndarray, classes: int) -> np.ndarray:
    """What the likelihood gains by each word (a row of counts of classes before and after it) in each class of the grid."""
    sums, cols = grid.sum(axis=1), grid.sum(axis=0)
    out = np.empty((len(before), classes))
    n_left, n_right = before.sum(axis=1), after.sum(axis=1)
    step = lambda at, n: _xlogx(at + n) - _xlogx(at)
    for k in range(classes):
        r, l, d = after[:, k], before[:, k], grid[k, k]
        out[:, k] = step(grid[k], after).sum(axis=1) + step(grid[:, k], before).sum(axis=1)
        out[:, k] += step(d, r + l) - step(d, r) - step(d, l)
        out[:, k] -= step(sums[k] + l, n_right) + step(cols[k] + r, n_left)
    return out


def _place(grid: np.ndarray, classes: int):
    """Rows (word, sides: array of (side, n)) to (word, class), and what the partition adds to the grid (word -1)."""
    schema, width = pa.schema([("word", pa.int64()), ("class", pa.int64()), ("n", pa.int64())]), classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.zeros((width, width), np.int64)
        for batch in small(batches, 2000):
            words = batch["word"].to_numpy()
            counts = np.zeros((len(words), 2 * width))
            flat = batch["sides"].flatten()
            owner = np.repeat(np.arange(len(words)), batch["sides"].value_lengths().to_numpy())
            counts[owner, flat.field("side").to_numpy()] = flat.field("n").to_numpy()
            keep = counts.sum(axis=1) >= LEAST_SEEN
            words, before, after = words[keep], counts[keep, :width], counts[keep, width:]
            best = gains(grid, before, after, classes).argmax(axis=1) if len(words) else np.zeros(0, np.int64)
            np.add.at(more, best, after.astype(np.int64))
            np.add.at(more.T, best, before.astype(np.int64))
            yield records(schema, [words, best, np.zeros(len(words), np.int64)])
        at = np.flatnonzero(more)
        yield records(schema, [np.full(len(at), -1), at, more.ravel()[at]])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, core: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the core words, from the bigram counts of core words, other words and ends; the last two stay alone."""
    size = classes + len(pairs) - core
    label = np.concatenate((np.arange(core) % classes, classes + np.arange(len(pairs) - core)))
    one = np.zeros((len(pairs), size))
    one[np.arange(len(pairs)), label] = 1
    grid = one.T @ pairs @ one
    right, left = pairs @ one, pairs.T @ one  # of each word with each class
    n_left, n_right = pairs.sum(axis=1), pairs.sum(axis=0)
    every = np.arange(size)
    for _ in range(rounds):
        moved = 0
        for w in range(core):
            old, own = label[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[old] -= own
            l[old] -= own  # to the rest of its class
            grid[old] -= r
            grid[:, old] -= l
            grid[old, old] -= own
            sums, cols = grid.sum(axis=1), grid.sum(axis=0)
            base = _xlogx(grid)
            gain = (_xlogx(grid + r) - base).sum(axis=1) + (_xlogx(grid.T + l) - base.T).sum(axis=1)
            d = grid[every, every]
            gain += _xlogx(d + r + l + own) - _xlogx(d) - (_xlogx(d + r) - _xlogx(d)) - (_xlogx(d + l) - _xlogx(d))
            gain -= _xlogx(sums + n_left[w]) - _xlogx(sums) + _xlogx(cols + n_right[w]) - _xlogx(cols)
            new = int(gain[:classes].argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            grid[new] += r
            grid[:, new] += l
            grid[new, new] += own
            if new != old:
                label[w] = new
                moved += 1
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
        if moved <= core // 200:
            break
    return label[:core]


class Model(NamedTuple):
    lookup: object  # broadcast
    counts: np.ndarray
    labels: np.ndarray  # class of each frequent word, then the tail's
    end: int
    transition: np.ndarray  # log10
    emission: np.ndarray  # log10, of frequent words
    tokens: int
    types: int
    ends: int
    tail_tokens: int
    tail_types: int


def _pairs(train: DataFrame, lookup, labels, other: int, end: int) -> np.ndarray:
    found = train.mapInArrow(_count_pairs(lookup, labels, other, end), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((end + 1) ** 2)
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(end + 1, end + 1)


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all training words (word: 64-bit hash, n)."""
    spark = train.sparkSession
    train = train.select("text")
    vocabulary = cut(train.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = train.count()
    size = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r["level"], r["types"], r["tokens"]) for r in vocabulary.groupBy(size.alias("level")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).collect()), reverse=True)
    types, total = sum(x[1] for x in levels), sum(x[2] for x in levels)
    least, head_types, head_tokens = 1 << 30, 0, 0
    for level, n, t in levels:
        if level == 0 or head_types + n > HEAD:  # words seen once stand for new ones
            break
        least, head_types, head_tokens = level, head_types + n, head_tokens + t
    head = vocabulary.where(size >= least).toArrow()
    words, counts = head["word"].to_numpy().view(np.uint64), head["n"].to_numpy()
    order = np.lexsort((words, -counts))
    words, counts = words[order], counts[order]
    lookup = spark.sparkContext.broadcast(Lookup(words).state)

    core = min(CORE, len(words))
    first = np.full(len(words), core)
    first[:core] = np.arange(core)
    pairs = _pairs(train, lookup, first, core, core + 1)
    core_class = exchange(pairs, core, CLASSES)
    known = np.full(len(words), -1)
    known[:core] = core_class
    one = np.zeros((core + 2, CLASSES + 1))
    one[np.arange(core), core_class] = one[core + 1, CLASSES] = 1
    grid = one.T @ pairs @ one
    width = 2 * (CLASSES + 1)
    for lo, hi in ((core, min(NEAR, len(words))), (min(NEAR, len(words)), len(words))):
        if lo < hi:
            sides = train.mapInArrow(_count_sides(lookup, known, CLASSES, lo, hi), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
            of_word = sides.groupBy(F.expr(f"word div {width}").alias("w")).agg(F.collect_list(F.struct((F.col("word") % width).cast("int").alias("side"), "n")).alias("sides"))
            found = of_word.withColumnRenamed("w", "word").mapInArrow(_place(grid, CLASSES), "word long, class long, n long").toArrow()  # at most hi - lo rows and some of the grid for each task
            word, label, n = (found[c].to_numpy() for c in ("word", "class", "n"))
            known[word[word >= 0]] = label[word >= 0]
            np.add.at(grid.ravel(), label[word < 0], n[word < 0])

    band = CLASSES + np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), BANDS - 1)
    labels = np.where(known >= 0, known, band)

    tail, end = CLASSES + BANDS, CLASSES + BANDS + 1
    grid = _pairs(train, lookup, labels, tail, end)
    share = (grid.sum(axis=0) + 1) / (grid.sum() + end + 1)
    transition = np.log10((grid + WEIGHT * share) / (grid.sum(axis=1, keepdims=True) + WEIGHT))
    mass = np.bincount(labels, counts, minlength=end + 1) if len(words) else np.zeros(end + 1)
    emission = np.log10(counts / mass[labels]) if len(words) else np.zeros(0)
    model = Model(lookup, counts, np.append(labels, tail), end, transition, emission, total + ends, types + (ends > 0), ends, total - head_tokens, types - head_types)
    return model, vocabulary.where(size < least)


def _score(shared, lookup):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, find = Model(*shared.value), opened(lookup)
        add = math.log10(m.tokens + m.types + 1)
        base = np.append(np.log10(m.counts + 1) - add, 0.0)
        emission = np.append(m.emission, 0.0)
        of_end = math.log10(m.ends + 1) - add
        for batch in small(batches):
            out: list[list] = [[] for _ in range(5)]
            for _, words, before in tokens(batch["text"].to_pylist()):
                at = find(words)
                labels = _with_ends(m.labels[at], before, m.end)
                steps = m.transition[labels[:-1], labels[1:]]
                lo, hi = before[:-1], before[1:]
                sums = lambda x, a, b: (s := np.concatenate(([0.0], np.cumsum(x))))[b] - s[a]
                known = np.concatenate(([0], np.cumsum(at >= 0)))
                texts = np.arange(len(lo))
                out[0] += (hi - lo + 1).tolist()
                out[1] += (known[hi] - known[lo] + (m.ends > 0)).tolist()
                out[2] += (sums(base[at], lo, hi) + of_end).tolist()
                out[3] += (sums(emission[at], lo, hi) + sums(steps, lo + texts, hi + texts + 1)).tolist()
                out[4] += [words[a:b][at[a:b] < 0].view(np.int64) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield records(schema, [batch["doc_id"], batch["held_out"], *out])

    return run


def score(docs: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model._replace(lookup=None)))
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>"
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(_score(shared, model.lookup), kinds).withColumn("row_id", F.monotonically_increasing_id())
    rows = cut(rows, "scored")
    rare = rows.select("row_id", F.explode("tail").alias("word"))
    n = F.coalesce("n", F.lit(0))
    found = rare.join(tail, "word", "left").select(
        "row_id",
        (n > 0).cast("long").alias("n_known"),
        (F.log10(n + 1) - math.log10(model.tokens + model.types + 1)).alias("base_score"),
        (F.log10(n + 1) - math.log10(model.tail_tokens + model.tail_types + 1)).alias("score"),
    )
    found = found.groupBy("row_id").agg(*[F.sum(c).alias(f"tail_{c}") for c in ("n_known", "base_score", "score")])
    both = rows.drop("tail").join(found, "row_id", "left")
    sums = [(F.col(c) + F.coalesce(f"tail_{c}", F.lit(0))).alias(c) for c in ("n_known", "base_score", "score")]
    return both.select("doc_id", "held_out", "n_tokens", sums[0], F.lit(model.tokens).cast("long").alias("train_tokens"), *sums[1:])


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (crc_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "text")
    model, tail = fit(docs.where("not held_out"))
    return score(docs, model, tail)
