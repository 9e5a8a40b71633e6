"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard checks.

Method: one permutation scatters the hashed shingles over a universe of 2^20 places, a second one ranks the places; its
circular shifts by 0, 1, 2, ... give all coordinates of a signature. So the signature of a shingle is one contiguous slice
of the (doubled) rank table, and that of a document the minimum over its slices. 28 bands of 5 coordinates meet at
Jaccard 0.85 with probability 1 - 7e-8.

Documents with equal word sequences are one class, known by 128 bits of the SHA-256 of the sequence, from the start: copies
never multiply. Then, on classes:
1. every member of a bucket is checked exactly against the bucket's smallest class (a star, never all pairs);
2. components of the confirmed links; a bucket inside one component is settled, as is one of two members;
3. classes of other buckets meet across components by their rarest shingles. Shingles are ordered by the number of these
   classes that hold them, those of one component first. Two sets over the threshold share one of the first
   n - ceil(threshold * n) + 1 of each, and at the first one they share enough must follow in both: pairs that can't link
   by their sizes and places are never made, and a class that shares too few shingles with other components has no pairs.
   Hashes are compared here, which can only let more pairs through. A pair must also differ in few enough shingles: those
   that only its own components hold and, of the others, the bits in which two bitmaps of parities differ. Where many
   classes of several components put one shingle first, all meet some of them, and linked ones become one component; more
   turns follow while they unite many. Words are sent for the pairs left, each pair once whatever the number of its
   buckets. A shingle that many classes put first has them dealt over blocks of bounded size;
4. components of all links.
Checks compare the words themselves: hashes only find candidates. Bounded Bloom filters keep the words of documents without
a candidate from being shuffled.

Edge cases: a null or wordless text has no shingles, n_shingles 0 and is linked with nothing: its component is its own id.
Fewer words than a shingle has are one shingle of their own length, equal only to the same words. Rows with an equal id are
texts of their own; component_id is the smallest id in the component, null ids aside. A null id stands for itself
(component_id null, unless linked; kept is false for a linked one and true otherwise). Further columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_hashes, cut, documents, gram_hashes, key_filter, mix64, passes, pieces, records, shuffle_width, small, word_bounds
from .components import connected_components

SHINGLE, THRESHOLD = 3, (85, 100)
BANDS, ROWS = 28, 5
UNIVERSE = 1 << 20
BLOCK = 512
SALTS = 16
HEAVY = 1 << 16
WAYS, HUBS, TURNS, YIELD = 64, 32, 8, 8
MARKS = 8

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("words", pa.binary()), ("text", pa.binary())])
_POSTINGS = pa.schema([(c, pa.int64()) for c in ("class", "component", "n", "shingle")])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all circular shifts of the ranking one as rows of a view."""
    rng = np.random.default_rng(20260)
    scatter, rank = rng.permutation(UNIVERSE).astype(np.int32), rng.permutation(UNIVERSE).astype(np.uint32)
    size = BANDS * ROWS
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate((rank, rank[:size])), size)


def shingle_sets(texts: list, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """The lower-cased words of each text, joined by blanks, and its sorted distinct 64-bit shingle hashes."""
    for _, blob, offsets in pieces(texts):
        blob = blob.lower()
        data = np.frombuffer(blob, np.uint8)
        starts, ends = word_bounds(data)
        grams = gram_hashes(byte_hashes(data, starts, ends), size)
        first = np.searchsorted(starts, offsets)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            words = b" ".join(blob[offsets[k] : offsets[k + 1]].split())
            yield words, np.unique(grams[a : b - size + 1]) if b - a >= size else np.full(int(b > a), b - a, np.uint64)


def _name(words: bytes) -> bytes:
    return hashlib.sha256(words).digest()[:16]


def _sign(shingle: int):
    odd = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, shifts = _permutations()
        for batch in small(batches):
            n, names, signatures, banded = [], [], [], []
            for words, hashes in shingle_sets(batch["text"].to_pylist(), shingle):
                n.append(len(hashes))
                names.append(_name(words) if words else None)
                banded.append(words.count(b" ") + 1 >= shingle and words != b"")  # fewer words equal only themselves
                places = scatter[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
                low = np.full(BANDS * ROWS, UNIVERSE, np.uint32)
                for k in range(0, len(places), 1024):
                    low = np.minimum(low, shifts[places[k : k + 1024]].min(axis=0))
                signatures.append(low)
            keys = mix64((np.array(signatures, np.uint64).reshape(len(n), BANDS, ROWS) * odd.reshape(BANDS, ROWS)).sum(axis=2, dtype=np.uint64))
            ends = np.concatenate(([0], np.cumsum(np.array(banded, np.int32) * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.array(banded, bool)].view(np.int64).ravel()))
            yield records(_SIGNED, [batch["doc_id"], n, names, bands])

    return run


def _key(names: list) -> np.ndarray:
    """What the sieve knows of a class name: its first 8 bytes."""
    return np.frombuffer(b"".join(x[:8] for x in names), ">i8").astype(np.int64)


def _wanted_texts(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t for t in (b" ".join((t or "").encode().lower().split()) for t in batch["text"].to_pylist()) if t]
            names = [_name(t) for t in texts]
            keep = passes(wanted.value, _key(names)) if names else ()
            yield records(_SETS, [[x for x, k in zip(c, keep, strict=True) if k] for c in (names, texts)])

    return run


def exact_shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text of size words or more, as numbers that are equal where the words are."""
    ids: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    words = [np.fromiter((ids.setdefault(w, len(ids)) for w in t), np.int64, len(t)) for t in split]
    code = plain = np.concatenate(words)
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths)
    for k in range(1, size):  # runs of k + 1 words are pairs of a run of k words and a word
        pair = code[:-1] * len(ids) + plain[k:]
        _, code = np.unique(pair, return_inverse=True)
    return [np.unique(code[e - n : e - size + 1]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def _similar(threshold: tuple[int, int], common, na, nb):
    part, whole = threshold
    return whole * common >= part * (na + nb - common)


def _confirm(shingle: int, threshold: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for a, b, *texts in zip(*(batch[c].to_pylist() for c in ("a", "b", "of_a", "of_b")), strict=True):
                x, y = exact_shingles(texts, shingle)
                if _similar(threshold, len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    out.append((a, b))
            yield records(_LINKS, list(zip(*out, strict=True)) if out else [[], []])

    return run


def _hashed(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 50):
            sets = [h for _, h in shingle_sets(batch["text"].to_pylist(), shingle)]
            sizes = [len(h) for h in sets]
            held = [np.repeat(batch[c].to_numpy(), sizes) for c in ("class", "component")]
            yield records(_POSTINGS, [*held, np.repeat(np.array(sizes, np.int64), sizes), np.concatenate(sets).view(np.int64)])

    return run


def _by_shingle(rows: DataFrame, of: DataFrame, size: str, total: int) -> DataFrame:
    """rows joined with of, which has one row a shingle and how many rows it has in all as size.

    Shingles with more than 1/HEAVY of all rows are fewer than HEAVY: they are broadcast, so no key of the shuffle is hot.
    """
    heavy, held = F.col(size) > total // HEAVY, [c for c in of.columns if c != "shingle"]
    often = rows.join(F.broadcast(of.where(heavy).select("shingle", F.struct(*held).alias("_of"))), "shingle", "left")
    seldom = often.where("_of is null").drop("_of").join(of.where(~heavy), "shingle")
    return often.where("_of is not null").select(*rows.columns, *[F.col(f"_of.{c}").alias(c) for c in held]).unionByName(seldom)


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of shingles that lie in several components, with their number df."""
    df = postings.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("x"), F.max("component").alias("y"))
    return _by_shingle(postings, cut(df.where("x != y").select("shingle", "df"), "shared"), "df", postings.count())


def fronts(postings: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The rarest shingles of each class, of which two that may link across components share one: shingle, class,
    component, n (set size), rest, how many shingles can still be shared from there on, own, how many no other component
    holds, and marks, a bitmap of 64 * MARKS parities of the others. Components may grow afterwards."""
    part, whole = threshold
    marks = [F.bit_xor(F.expr(f"if(shiftright(shingle, 6) & {MARKS - 1} = {k}, shiftleft(1L, cast(shingle & 63 as int)), 0L)")) for k in range(MARKS)]
    held = F.array_sort(F.collect_list(F.struct("df", "shingle")))
    sets = _shared(postings).groupBy("class", "component", "n").agg(held.alias("held"), F.array(*marks).alias("marks"))
    own = F.col("n") - F.size("held")  # these come first
    first = F.expr(f"n - (n * {part} + {whole - 1}) div {whole} + 1")
    sets = sets.where(f"{whole} * size(held) >= {part} * n")
    front = F.slice("held", F.lit(1), F.greatest(F.lit(0), first - own).cast("int"))
    each = sets.select("class", "component", "n", own.alias("own"), "marks", F.posexplode(front).alias("k", "x"))
    return cut(each.select("class", "component", "n", F.expr("n - own - k").alias("rest"), "own", "marks", "x.shingle"), "front")


def _fits(threshold: tuple[int, int]) -> str:
    """What two rows of the front must be for their classes to link: enough is left to share, and few enough differ."""
    part, whole = threshold
    differ = " + ".join(["own_a + own_b", *(f"bit_count(marks_a[{k}] ^ marks_b[{k}])" for k in range(MARKS))])
    share = f"{whole} * least(rest_a, rest_b) >= {part} * (n_a + n_b - least(rest_a, rest_b))"
    return f"component_a != component_b and {share} and {whole + part} * ({differ}) <= {whole - part} * (n_a + n_b)"


_ROW = ("class", "component", "n", "rest", "own", "marks")


def _side(x: str) -> list:
    return [F.col(c).alias(f"{c}_{x}") for c in ("shingle", *_ROW)]


def merged(front: DataFrame, threshold: tuple[int, int], confirmed: Callable) -> tuple[DataFrame, DataFrame | None]:
    """The front with larger components, and the links that made them.

    Where a shingle has more than WAYS pairs of different components for each of its rows, all its classes are checked
    against HUBS of them: those with most left to share, in later turns other ones. So many classes near each other become
    one component, whose pairs need no check, at a cost in proportion to the front. It ends when no shingle is left, a turn
    unites less than 1/YIELD of the components or after TURNS; the pairs left are for across().
    """
    placed, links = cut(front.select("class", "component").distinct(), "placed"), None
    for turn in range(TURNS):
        size = front.groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.sum("c").alias("m"), F.expr("sum(c) * sum(c) - sum(c * c)").alias("ordered"))
        crowded = cut(size.where(f"ordered > {2 * WAYS} * m").select("shingle", "m"), "crowded")
        if crowded.isEmpty():
            break
        rows = _by_shingle(front, crowded, "m", front.count())
        mark = F.xxhash64("class", F.lit(turn))
        order = F.struct(F.expr("n - rest") if turn == 0 else F.lit(0), mark)
        hubs = rows.groupBy("shingle", "m", F.pmod(mark, F.lit(HUBS)).alias("k")).agg(F.min_by(F.struct(*_ROW), order).alias("hub"))
        hubs = cut(hubs.groupBy("shingle", "m").agg(F.collect_list("hub").alias("hubs")), "hubs")
        pairs = _by_shingle(front.select("shingle", *_side("a")[1:]), hubs, "m", front.count()).withColumn("hub", F.explode("hubs"))
        pairs = pairs.select("*", *[F.col(f"hub.{c}").alias(f"{c}_b") for c in _ROW]).where(_fits(threshold))
        new = confirmed(pairs.select(F.greatest("class_a", "class_b").alias("a"), F.least("class_a", "class_b").alias("b")).distinct())
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        for side in ("a", "b"):
            new = new.join(placed.select(F.col("class").alias(side), F.col("component").alias(f"of_{side}")), side)
        found = connected_components(new.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        before = placed.select("component").distinct().count()
        placed = placed.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        placed = cut(placed.select("class", F.coalesce("to", "component").alias("component")), "placed")
        front = cut(front.drop("component").join(placed, "class"), "front")
        if YIELD * (before - placed.select("component").distinct().count()) < before:
            break
    return front, links


def across(front: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """a > b: classes of different components that may link."""
    blocks = front.groupBy("shingle").agg(F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    blocks = blocks.select("shingle", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = cut(_by_shingle(front, blocks, "m", BLOCK * HEAVY + front.count()).withColumn("mine", F.pmod(F.xxhash64("class"), "blocks").cast("int")), "dealt")
    each = F.explode(F.expr("sequence(0, blocks - 1)"))
    left = dealt.select(*_side("a"), F.col("mine").alias("i_a"), each.alias("j_a"))
    right = dealt.select(*_side("b"), each.alias("i_b"), F.col("mine").alias("j_b"))
    pairs = left.join(right, F.expr(f"shingle_a = shingle_b and i_a = i_b and j_a = j_b and class_a > class_b and {_fits(threshold)}"))
    return pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text).

    threshold: the least Jaccard similarity as a fraction; the bands are made for 4/5 and more.
    """
    spark = docs.sparkSession
    part, whole = threshold
    slim = docs.select("doc_id", "text")
    signed = slim.mapInArrow(_sign(shingle), "doc_id long, n long, words binary, bands array<long>").withColumn("row", F.monotonically_increasing_id())
    signed = cut(signed, "signed")
    classes = signed.where("words is not null").groupBy("words").agg(F.min("row").alias("class"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes, "classes")
    rows = classes.select("class", "n", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("class").alias("hub"), F.max("class").alias("top")).where("hub != top")
    members = cut(rows.join(buckets.select("band", "hub"), "band"), "members")

    linked = cut(classes.select("words", "class").join(members.select("class").distinct(), "class", "left_semi"), "linked")
    wanted = spark.sparkContext.broadcast(key_filter(linked.select(F.expr("cast(conv(hex(substring(words, 1, 8)), 16, -10) as long)").alias("key")), "key"))
    texts = slim.mapInArrow(_wanted_texts(wanted), "words binary, text binary").groupBy("words").agg(F.first("text").alias("text"))
    texts = cut(texts.join(linked, "words").select("class", "text"), "texts")
    hubs = members.groupBy("band", "hub").agg(F.max(F.when(F.col("class") == F.col("hub"), F.col("n"))).alias("hub_n"))
    pairs = members.join(hubs.select("band", "hub_n"), "band").where(f"class != hub and {whole} * least(n, hub_n) >= {part} * greatest(n, hub_n)").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("of_a")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("of_b")), "b")
        return cut(both.mapInArrow(_confirm(shingle, threshold), "a long, b long"), "links")

    links = confirmed(pairs)
    found = cut(connected_components(links), "components")

    # Buckets of three or more members that lie in several components.
    placed = members.select("band", "class").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x != y and m > 2").select("band")
    open_ = placed.join(open_, "band").select("class", "component").distinct()
    postings = texts.join(open_, "class").select("class", "component", F.col("text").cast("string").alias("text"))
    postings = cut(postings.mapInArrow(_hashed(shingle), "class long, component long, n long, shingle long"), "postings")
    front, more = merged(fronts(postings, threshold), threshold, confirmed)
    last = confirmed(across(front, threshold).join(pairs, ["a", "b"], "left_anti"))
    more = last if more is None else more.unionByName(last)
    if not more.isEmpty():
        found = cut(connected_components(links.unionByName(more)), "components")

    # The smallest id of each component; large components are dealt over several tasks on their way back.
    salt = F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")
    of = classes.select("class", "least").join(found.withColumnRenamed("node", "class"), "class")
    ids = of.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = of.select("class", "component", salt.alias("salt")).join(ids, ["component", "salt"]).select("class", "component_id")
    named = classes.join(named, "class", "left").select("words", F.coalesce("component_id", "least").alias("component_id"))
    out = signed.select("doc_id", "n", "words").join(named, "words", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
