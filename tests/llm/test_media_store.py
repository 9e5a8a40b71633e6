import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest
from tidemill.llm import media_store as m
from tidemill.llm.media_store import media_columns, op9_media_columns


def want(i, t):
    """All columns by plain loops."""
    b = (t or "").encode()
    p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
    ends = plain_cuts(p)
    chunks = [p[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
    form = b"CDC1" + struct.pack("<QI", len(p), len(chunks)) + b"".join(struct.pack("<I", len(c)) + hashlib.sha256(c).digest() for c in chunks)
    mean, square = sum(p) / len(p), sum(x * x for x in p) / len(p)
    entropy = -sum(n / len(p) * math.log2(n / len(p)) for n in Counter(p).values()) + 0.0
    feature = f"chunks={len(chunks)};mean={mean:.6f};rms={square**0.5:.6f};zeros={p.count(0)};entropy={entropy:.6f}"
    return i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature


def check(rows, got):
    assert sorted(map(tuple, got), key=str) == sorted((want(*r) for r in rows), key=str)


def plain_cuts(p):
    ends, start, h = [], 0, 0
    for i, b in enumerate(p):
        h = ((h << 1) + int(m.GEAR[b])) & (2**64 - 1)
        size = i + 1 - start
        if size >= m.LEAST and h >> (64 - m.MASK_BITS) == 0 or size == m.MOST:
            ends.append(i + 1)
            start = i + 1
    return ends if start == len(p) else [*ends, len(p)]


def test_cuts_match_the_rolling_loop():
    rng = random.Random(5)
    payloads = [rng.randbytes(64 * n) for n in (1, 3, 400, 900)] + [bytes(64 * 300), b"ab" * 32 * 70]
    assert list(m.cuts(payloads)) == [plain_cuts(p) for p in payloads]


def test_cuts_move_with_the_content():
    rng = random.Random(6)
    p = rng.randbytes(64_000)

    def pieces(x):
        ends = next(m.cuts([x]))
        return {x[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    assert len(pieces(p) & pieces(b"0123456" + p)) > 0.9 * len(pieces(p))


def test_store_is_checked():
    chunks = [b"a" * 300, b"b" * 20, b"c" * 9]
    media = m.store(chunks, [hashlib.sha256(c).digest() for c in chunks])
    assert m.read(media, b"".join(chunks), {}) == (b"".join(chunks), 3)
    assert m.read(media, chunks[0] + chunks[2], {1: chunks[1]}) == (b"".join(chunks), 3)
    for pack, shared in ((chunks[0] + chunks[2] + b"x", {1: chunks[1]}), (chunks[0] + b"d" * 9, {1: chunks[1]}), (chunks[0] + chunks[2], {})):
        with pytest.raises(ValueError):
            m.read(media, pack, shared)


def test_shared_bytes_lie_once(spark):
    rng = random.Random(3)
    common = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    rows = [(k, f"{rng.random()} " * 40 + common) for k in range(50)]
    media, chunks = m.stored(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(len(r.bytes) for r in chunks.collect()) <= len(common)  # not 50 times that
    assert all(len(r.pack) <= r.n_bytes - len(common) + 64 + m.MOST for r in media.collect())
    digests = [r.digest for r in chunks.collect()]
    assert len(set(digests)) == len(digests) > 10


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, op9_media_columns(spark, sf).collect())


def test_edges(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh é") for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, "a"), (4, "x" * 64), (5, "x" * 65), (5, "x" * 65), (None, "é"), (7, long), (7, long), (8, "pre" + long), (9, "y" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as row_id", "3 as pos")
    check(rows, media_columns(df).collect())
    assert media_columns(df.limit(0)).count() == 0
