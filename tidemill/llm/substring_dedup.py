"""Substring dedup: remove every word that lies in a run of words which also starts elsewhere.

Method: suffix automata of reference shards. The reference is the corpus itself, which has no size bound, so its shards
are not broadcast whole; each piece of text is sent to the one shard that can hold its repeats. The route is a winnowing
anchor: of every run of `window` words the smallest hash among its inner runs of about half that length. Equal runs have
equal anchors, so all starts of a run meet in the shard of its anchor. There a suffix automaton of the shard's distinct
pieces, with weighted occurrence counts, gives each piece its matching statistics: a run of full length whose state
counts two or more starts is repeated. The automata compare words by their bytes and decide every run; hashes only bring
pieces together. Bounded Bloom filters of the shared anchors keep all other pieces from being shuffled.

An anchor with more than SHARD distinct pieces would make a shard without a bound. Its pieces fall apart into single runs
of `window` words; those whose hash comes twice are dealt by that hash over shards of about SHARD runs, one row a distinct
run with the sum of its starts, and automata of these decide them.

Edge cases: a null or empty text has no words (n_words 0, hash of the empty text). Texts shorter than the window keep all
words. Equal rows, and rows with an equal id, each count as texts of their own: a row that appears twice repeats itself.
An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_hashes, cut, documents, gram_hashes, key_filter, mix64, passes, pieces, records, shuffle_width, small, word_bounds, word_runs

WINDOW = 35
#: Sequences in a shard, about: an anchor with more distinct pieces makes several shards of single runs.
SHARD = 512

#: Runs of one text whose anchors are looked for at a time; positions among them have 24 bits.
PART = 1 << 23

_ANCHORS = pa.schema([("anchor", pa.int64())])
_PIECES = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("row_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])
_MASKS = "anchor long, piece long, mask long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _anchors(blob: bytes, offsets: np.ndarray, window: int):
    """Per run of windows with one anchor: anchor hash, hash of the piece, index of the text, first word, windows, bytes."""
    data = np.frombuffer(blob, np.uint8)
    starts, ends = word_bounds(data)
    count = len(starts) - window + 1
    if count <= 0:
        return None
    words = byte_hashes(data, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    size = (window + 1) // 2
    span = window - size + 1  # inner runs in a window
    grams = gram_hashes(words, size)
    rank, at = mix64(grams), np.empty(count, np.int64)
    for a in range(0, count, PART):
        part = rank[a : a + PART + span - 1]
        low = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        at[a : a + PART] = (low & np.uint64((1 << 24) - 1)).astype(np.int64) + a
    good = owner[:count] == owner[window - 1 :]
    first = np.flatnonzero(good & np.concatenate(([True], (at[1:] != at[:-1]) | ~good[:-1])))
    stop = np.flatnonzero(good & np.concatenate(((at[1:] != at[:-1]) | ~good[1:], [True]))) + 1
    n = stop - first
    last = first + n + window - 2
    base = np.searchsorted(starts, offsets[:-1])  # first word of each text
    whose = owner[first]
    return grams[at[first]].view(np.int64), word_runs(words, first, last + 1).view(np.int64), whose, first - base[whose], n, starts[first], ends[last]


def _emit_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for _, blob, offsets in pieces(batch["text"].to_pylist()):
                if (found := _anchors(blob, offsets, window)) is not None:
                    yield records(_ANCHORS, [found[0]])

    return run


def _emit_pieces(window: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, keys = batch["row_id"].to_numpy(), batch["row_key"].to_numpy()
            for first, blob, offsets in pieces(batch["text"].to_pylist()):
                if (found := _anchors(blob, offsets, window)) is None:
                    continue
                keep = np.flatnonzero(passes(shared.value, found[0]))
                for k in range(0, len(keep), 4096):
                    anchor, piece, whose, start, _, lo, hi = (x[keep[k : k + 4096]] for x in found)
                    words = [b" ".join(blob[a:b].split()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                    yield records(_PIECES, [anchor, piece, ids[first + whose], keys[first + whose], start.astype(np.int32), words])

    return run


class SuffixAutomaton:
    """Of several sequences, each with a weight; `starts` counts the weighted starts of every run a state stands for."""

    def __init__(self, sequences: list[list[int]], weights: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.starts = [-1], [0], [0]
        for sequence, weight in zip(sequences, weights, strict=True):
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                self.starts[last] += weight
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.starts[self.link[state]] += self.starts[state]

    def _split(self, state: int, symbol: int, target: int) -> int:
        clone = len(self.length)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.starts.append(0)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if (known := self.next[last].get(symbol)) is not None:  # another sequence has come this way
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new = len(self.length)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.starts.append(0)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
        return new

    def repeated(self, sequence: list[int], window: int) -> int:
        """Bit i is set if the run of window symbols at i has two starts or more."""
        mask, state, matched = 0, 0, 0
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.starts[state] >= 2:
                mask |= 1 << (i - window + 1)
        return mask


def _shard(window: int):
    """Rows come sorted by shard."""

    def solve(held: list[tuple[int, int, int, bytes]]):
        ids: dict[bytes, int] = {}
        sequences = [[ids.setdefault(w, len(ids)) for w in words.split()] for *_, words in held]
        automaton = SuffixAutomaton(sequences, [weight for _, _, weight, _ in held])
        for (anchor, piece, *_), sequence in zip(held, sequences, strict=True):
            if mask := automaton.repeated(sequence, window):
                yield anchor, piece, mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("mask", pa.int64())])
        now, held = None, []
        for batch in batches:
            out = []
            for shard, *row in zip(*(batch[c].to_pylist() for c in ("shard", "anchor", "piece", "weight", "words")), strict=True):
                if shard != now:
                    out += solve(held)
                    now, held = shard, []
                held.append(row)
            yield records(schema, list(zip(*out, strict=True)) if out else [[], [], []])
        if out := list(solve(held)):
            yield records(schema, list(zip(*out, strict=True)))

    return run


def _of_size(large, wanted: bool):
    """The pieces of large anchors, or of the others. An anchor the filter takes for a large one is treated alike in all
    its pieces, so nothing is lost by that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(large.value, batch["anchor"].to_numpy()) == wanted))

    return run


def _runs(window: int):
    """The single runs of pieces: piece, offset in it, hash of the run's words."""
    schema = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("weight", pa.int64()), ("bit", pa.int32()), ("run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in schema.names]
            for anchor, piece, weight, words in zip(*(batch[c].to_pylist() for c in ("anchor", "piece", "weight", "words")), strict=True):
                data = np.frombuffer(words, np.uint8)
                hashes = gram_hashes(byte_hashes(data, *word_bounds(data)), window).view(np.int64)
                n = len(hashes)
                for column, values in zip(out, ([anchor] * n, [piece] * n, [weight] * n, range(n), hashes.tolist()), strict=True):
                    column += values
            yield records(schema, out)

    return run


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[], [], [], []]
            spans = batch["spans"].to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            for text, found in zip(batch["text"].to_pylist(), spans, strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if found:
                    edge = np.zeros(n + window + 1, np.int64)
                    for x in found:
                        for i in range(x["mask"].bit_length()):
                            if x["mask"] >> i & 1:
                                edge[x["start"] + i] += 1
                                edge[x["start"] + i + window] -= 1
                    words = [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]
                kept = b" ".join(words)
                for column, value in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    column.append(value)
            yield records(schema, [batch["doc_id"], *out])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_id, row_key, spans: array of (start, mask): bit i of mask marks a repeated run of window words at start + i.

    docs has row_id and row_key, which together name a row, and text. window: 3 to 100 words.
    """
    spark = docs.sparkSession
    slim = docs.select("row_id", "row_key", "text")
    counts = cut(slim.select("text").mapInArrow(_emit_anchors(window), "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    shared = spark.sparkContext.broadcast(key_filter(counts, "anchor"))
    found = cut(slim.mapInArrow(_emit_pieces(window, shared), "anchor long, piece long, row_id long, row_key long, start int, words binary"), "pieces")
    distinct = cut(found.groupBy("anchor", "piece").agg(F.count("*").alias("weight"), F.first("words").alias("words")), "distinct")
    kinds = "anchor long, piece long, weight long, words binary"
    many = spark.sparkContext.broadcast(key_filter(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n > {SHARD}"), "anchor"))
    whole = distinct.mapInArrow(_of_size(many, False), kinds).withColumn("shard", F.col("anchor"))

    large = distinct.mapInArrow(_of_size(many, True), kinds)
    runs = cut(large.mapInArrow(_runs(window), "anchor long, piece long, weight long, bit int, run long"), "runs")
    often = cut(runs.groupBy("anchor", "run").agg(F.sum("weight").alias("weight"), F.min(F.struct("piece", "bit")).alias("at")).where("weight > 1"), "often")
    most = often.groupBy("anchor").count().agg(F.max("count")).first()[0] or 1
    bits = max(0, (most // SHARD).bit_length())
    deal = F.xxhash64("anchor", F.shiftrightunsigned("run", 64 - bits)) if bits else F.col("anchor")
    single = often.select("anchor", "run", "weight", "at.piece", "at.bit").join(large.select("anchor", "piece", "words"), ["anchor", "piece"])
    words = F.array_join(F.slice(F.split(F.col("words").cast("string"), " "), F.col("bit") + 1, window), " ").cast("binary")
    single = single.select("anchor", F.col("run").alias("piece"), "weight", words.alias("words"), deal.alias("shard"))

    parts = whole.unionByName(single).repartition(shuffle_width(spark), "shard").sortWithinPartitions("shard").mapInArrow(_shard(window), _MASKS)
    masks = cut(parts, "masks")
    of_large = F.expr("shiftleft(1L, bit)").alias("mask")
    by_run = runs.join(masks.select("anchor", F.col("piece").alias("run")), ["anchor", "run"], "left_semi").select("anchor", "piece", of_large).groupBy("anchor", "piece").agg(F.bit_or("mask").alias("mask"))
    spans = found.select("anchor", "piece", "row_id", "row_key", "start").join(masks.mapInArrow(_of_size(many, False), _MASKS).unionByName(by_run), ["anchor", "piece"])
    return spans.groupBy("row_id", "row_key").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space) of every row of docs."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_id", F.coalesce("doc_id", F.lit(0))).withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = cut(repeated_spans(keyed, window), "spans")
    hit = spark.sparkContext.broadcast(key_filter(spans, "row_key"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("row_id", pa.int64()), ("row_key", pa.int64())])

    def sift(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = passes(hit.value, batch["row_key"].to_numpy()) == wanted
                yield records(schema, [batch[c] for c in schema.names]).filter(pa.array(keep))

        return run

    kind = "doc_id long, text string, row_id long, row_key long"
    clean = keyed.mapInArrow(sift(False), kind).mapInArrow(_remove(window), _RESULT)
    touched = keyed.mapInArrow(sift(True), kind).join(spans, ["row_id", "row_key"], "left").select("doc_id", "text", "spans").mapInArrow(_remove(window), _RESULT)
    return clean.unionByName(touched)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).drop("kept_text")
