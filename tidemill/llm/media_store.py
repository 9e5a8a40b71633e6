"""Media columns by content-defined payload chunking.

Method: a gear hash rolls over the payload; it depends on the last 64 bytes, so all its values come from six doublings of
the whole array. A chunk ends where the top 10 bits of the hash are zero, after 256 bytes at least and 8192 at most. Chunk
digests (SHA-256) are counted over the corpus. The stored form of a payload is the ordered list of its chunks: 4 bytes
`CDC1`, the payload length, the number of chunks, then length and digest of each. The bytes, samples of 8 bits, lie once in
the chunk table: a chunk that may occur more than once in the shared chunk store, one row a digest, all others in one pack
beside the list. Lists, packs and store are written as Parquet and read again; reading joins the list with the store,
checks every digest and puts the payload together; all features come from the bytes read back.

The payload is the text's UTF-8 bytes with zero bytes up to a positive multiple of 64. A bounded Bloom filter tells which
chunks may occur again; it is a sieve only: what passes it falsely is stored shared all the same and read back by the join.

Edge cases: null and empty texts have 64 zero bytes. Equal texts have equal results. Rows with equal ids stay apart. An
empty table gives an empty result. A digest that does not fit its bytes raises an error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, key_filter, mix64, passes, records, small

UNIT = 64
LEAST, MOST, MASK_BITS = 256, 8192, 10
GEAR = mix64(np.arange(1, 257, dtype=np.uint64))

_KEYS = pa.schema([("key", pa.int64())])
_STORED = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("pack", pa.binary()), ("n_shared", pa.int32()), ("digest", pa.binary()), ("bytes", pa.binary())])
_WANTED = pa.schema([("row_id", pa.int64()), ("pos", pa.int32()), ("digest", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_KINDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[int, bytes]:
    b = (text or "").encode()
    return len(b), b + bytes((-len(b)) % UNIT or (UNIT if not b else 0))


def cuts(payloads: list[bytes]) -> Iterator[list[int]]:
    """The chunk ends of each payload."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    h = GEAR[data]
    reach = 1
    while reach < 64:
        h[reach:] += h[:-reach] << np.uint64(reach)
        reach *= 2
    good = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    at = 0
    for p in payloads:
        lo, hi = np.searchsorted(good, (at, at + len(p)))
        ends, start = [], 0
        for end in (good[lo:hi] - at).tolist():
            while end - start > MOST:
                start += MOST
                ends.append(start)
            if end - start >= LEAST:
                ends.append(end)
                start = end
        while len(p) - start > MOST:
            start += MOST
            ends.append(start)
        if start < len(p):
            ends.append(len(p))
        yield ends
        at += len(p)


def chunked(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """UTF-8 length, chunks and digests of each text, some megabytes of texts at a time."""
    texts, at = batch["text"].to_pylist(), 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < 1 << 19):
            group.append(payload(texts[at]))
            size += len(group[-1][1])
            at += 1
        for (n, p), ends in zip(group, cuts([p for _, p in group]), strict=True):
            chunks = [p[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield n, chunks, [hashlib.sha256(c).digest() for c in chunks]


def _key(digest: bytes) -> int:
    return struct.unpack(">q", digest[:8])[0]


def store(chunks: list[bytes], digests: list[bytes]) -> bytes:
    """The stored form: the list of chunks."""
    head = struct.pack("<4sQI", b"CDC1", sum(map(len, chunks)), len(chunks))
    return b"".join((head, *(struct.pack("<I32s", len(c), d) for c, d in zip(chunks, digests, strict=True))))


def entries(media: bytes) -> list[tuple[int, bytes]]:
    """Length and digest of each chunk of a stored form."""
    magic, size, n = struct.unpack_from("<4sQI", media)
    out = list(struct.iter_unpack("<I32s", media[16:]))
    if magic != b"CDC1" or len(out) != n or sum(x for x, _ in out) != size:
        raise ValueError("not a stored payload")
    return out


def read(media: bytes, pack: bytes, shared: dict[int, bytes]) -> tuple[bytes, int]:
    """The verified payload of a stored form, from its pack and the shared chunks by place; and its number of chunks."""
    at, parts = 0, []
    for k, (length, digest) in enumerate(entries(media)):
        if k in shared:
            parts.append(shared[k])
        else:
            parts.append(pack[at : at + length])
            at += length
        if len(parts[-1]) != length or hashlib.sha256(parts[-1]).digest() != digest:
            raise ValueError("a chunk does not fit its digest")
    if at != len(pack):
        raise ValueError("a pack does not fit its list")
    return b"".join(parts), len(parts)


def _row(doc_id, n_bytes: int, media: bytes, pack: bytes, shared: dict[int, bytes]) -> tuple:
    p, n = read(media, pack, shared)
    samples = np.frombuffer(p, np.uint8)
    count = np.bincount(samples, minlength=256)
    share = count[count > 0] / len(samples)
    values = np.arange(256)
    mean, square = (count * values).sum() / len(samples), (count * values * values).sum() / len(samples)
    feature = f"chunks={n};mean={mean:.6f};rms={square**0.5:.6f};zeros={int(count[0])};entropy={-(share * np.log2(share)).sum() + 0.0:.6f}"
    return doc_id, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature


def _columns(rows: list[tuple]) -> list:
    return list(zip(*rows, strict=True)) if rows else [[] for _ in _RESULT.names]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        yield records(_KEYS, [[_key(d) for _, _, digests in chunked(batch) for d in digests]])


def _keys_of(digests: list[bytes]) -> np.ndarray:
    return np.array([_key(d) for d in digests], np.int64)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 100):
        parts = batch["parts"].to_pylist() if "parts" in batch.schema.names else [()] * batch.num_rows
        rows = zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media", "pack")), parts, strict=True)
        yield records(_RESULT, _columns([_row(i, n, media, pack, {x["pos"]: x["bytes"] for x in own}) for i, n, media, pack, own in rows]))


def stored(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written tables: row_id, doc_id, n_bytes, media, pack, n_shared of every row; digest, bytes of the shared chunks."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    repeated = slim.mapInArrow(_keys, "key long").groupBy("key").count().where("count > 1")
    known = spark.sparkContext.broadcast(key_filter(repeated, "key"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """List and pack of each payload, and the chunks that may be shared, most of them once a task."""
        seen: set[bytes] = set()
        for batch in small(batches):
            out = []
            for doc_id, row_id, (n, chunks, digests) in zip(batch["doc_id"].to_pylist(), batch["row_id"].to_pylist(), chunked(batch), strict=True):
                shared = passes(known.value, _keys_of(digests)).tolist()
                pack = b"".join(c for c, s in zip(chunks, shared, strict=True) if not s)
                out.append((row_id, doc_id, n, store(chunks, digests), pack, sum(shared), None, None))
                for c, d, s in zip(chunks, digests, shared, strict=True):
                    if s and d not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(d)
                        out.append((None, None, None, None, None, None, d, c))
            yield records(_STORED, list(zip(*out, strict=True)) if out else [[] for _ in _STORED.names])

    kinds = "row_id long, doc_id long, n_bytes long, media binary, pack binary, n_shared int, digest binary, bytes binary"
    table = cut(slim.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(write, kinds), "media")
    chunk_store = cut(table.where("digest is not null").groupBy("digest").agg(F.first("bytes").alias("bytes")), "chunk-store")
    return table.where("digest is null").drop("digest", "bytes"), chunk_store


def media_columns(docs: DataFrame) -> DataFrame:
    """The digest columns of every row's payload, as read back from its stored form."""
    spark = docs.sparkSession
    media, chunk_store = stored(docs)
    known = spark.sparkContext.broadcast(key_filter(chunk_store.select(F.expr("cast(conv(hex(substring(digest, 1, 8)), 16, -10) as long)").alias("key")), "key"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for row_id, form in zip(batch["row_id"].to_pylist(), batch["media"].to_pylist(), strict=True):
                digests = [d for _, d in entries(form)]
                out += [(row_id, k, digests[k]) for k in np.flatnonzero(passes(known.value, _keys_of(digests))).tolist()]
            yield records(_WANTED, list(zip(*out, strict=True)) if out else [[] for _ in _WANTED.names])

    alone = media.where("n_shared = 0").select("doc_id", "n_bytes", "media", "pack").mapInArrow(_assemble, _KINDS)
    mixed = media.where("n_shared > 0")
    found = mixed.select("row_id", "media").mapInArrow(wanted, "row_id long, pos int, digest binary").join(chunk_store, "digest")
    parts = found.groupBy("row_id").agg(F.collect_list(F.struct("pos", "bytes")).alias("parts"))
    joined = mixed.join(parts, "row_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<pos:int,bytes:binary>>")))
    return alone.unionByName(joined.select("doc_id", "n_bytes", "media", "pack", "parts").mapInArrow(_assemble, _KINDS))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
