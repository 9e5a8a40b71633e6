import base64
import hashlib
import math
from collections import Counter

import numpy as np
from tidemill.llm import common
from tidemill.llm import fingerprint as f
from tidemill.llm.fingerprint import fingerprints, op7_fingerprint


def test_levels_match_plain_entropy():
    rng = np.random.default_rng(1)
    data = np.concatenate((rng.integers(0, 9, 300), np.zeros(100), rng.integers(0, 256, 300))).astype(np.uint8)
    got = f.window_levels(data)
    for i in range(0, len(got), 7):
        c = Counter(data[i : i + 64].tolist())
        h = -sum(v / 64 * math.log2(v / 64) for v in c.values())
        assert abs(got[i] - h / 6 * 1023) <= 1


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out.append((i, t, n, e))
    return out


def check(rows, got):
    want = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, _, e in plain(rows)), key=str)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = op7_fingerprint(spark, sf).collect()
    check(rows, got)
    by = {r.doc_id: r for r in got}
    rank = f.rarity(docs)
    same = {}
    for i, t, n, e in plain(rows)[:200]:
        a, b, c = f.digests(rank, [t.encode(), e.encode(), n.encode()])
        assert (by[i].fingerprint, by[i].edited_fingerprint) == (str(a), str(b))
        assert (by[i].near_edited, by[i].near_next) == (f.likeness(a, b), f.likeness(a, c))
        assert same.setdefault(t, by[i].fingerprint) == by[i].fingerprint
    long = [r for r in got if r.n_chars > 1000]
    print(np.percentile([r.near_edited for r in long], [1, 10, 50]), np.percentile([r.near_next for r in long], [50, 90, 99]))
    assert np.percentile([r.near_edited for r in long], 2) > np.percentile([r.near_next for r in long], 90)


def test_edges(spark):
    long = "".join(chr(97 + k * k % 23) for k in range(40_000))
    rows = [(1, None), (2, ""), (3, "a"), (4, "é" * 40), (5, "x" * 64), (5, "x" * 64), (5, "short"), (None, "null id " * 20), (9, long), (10, long + "é"), (-3, "😀" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as last", "3 as at", "4 as level")
    got = fingerprints(df).collect()
    check(rows, got)
    assert [r.fingerprint for r in got if r.n_chars == 0] == ["", ""]
    assert len({r.fingerprint for r in got if r.n_chars == 64}) == 1
    one = fingerprints(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprints(df.limit(0)).count() == 0


def plain_mix(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by & (2**64 - 1)
    return x ^ x >> 31


def plain_levels(data):
    whole = round(64 * 6 * 2**20)
    out = []
    for i in range(len(data) - 63):
        parts = sum(round(c * math.log2(c) * 2**20) for c in Counter(data[i : i + 64]).values())
        out.append((whole - parts) * 1023 // whole)
    return out


def plain_digest(rank, data):
    """Features by loops over windows and runs; (number, bits set) of each filter of the chain."""
    levels, votes = plain_levels(data), Counter()
    for start in range(-63, len(levels)):
        run = range(max(0, start), min(len(levels), start + 64))
        votes[min(run, key=lambda k: (rank[levels[k]], k))] += 1
    seen = list(dict.fromkeys(data[k : k + 64] for k in sorted(votes) if votes[k] >= 16))
    hashes = [plain_mix(sum(int(common._TABLE[k * 256 + c]) for k, c in enumerate(w)) & (2**64 - 1)) for w in seen]
    chain = []
    for k in range(0, len(hashes), 160):
        part = hashes[k : k + 160]
        chain.append((len(part), {h >> 11 * j & 2047 for h in part for j in range(5)}))
    return chain


def plain_likeness(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    total = 0.0
    for n, x in a:
        best = 0.0
        for _, y in b:
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            best = max(best, min(1.0, (len(x & y) - chance) / max(most - chance, 1e-9)))
        total += n * best
    return total / sum(n for n, _ in a)


def test_digests_match_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count = Counter(x for _, t in rows for x in plain_levels((t or "").encode()))
    rank = {x: k for k, x in enumerate(sorted(range(1024), key=lambda x: (count[x], x)))}
    assert f.rarity(docs).tolist() == [rank[x] for x in range(1024)]
    got = {r.doc_id: r for r in op7_fingerprint(spark, sf).collect()}
    done = 0
    for i, t, n, e in plain(rows):
        if all(64 <= len(x.encode()) < 2500 for x in (t, n, e)):
            a, b, c = (plain_digest(rank, x.encode()) for x in (t, e, n))
            assert [(int(x.split(".")[0]), set(np.flatnonzero(np.unpackbits(np.frombuffer(base64.b64decode(x.split(".")[1]), np.uint8))).tolist())) for x in got[i].fingerprint.split("-")] == a
            assert abs(got[i].near_edited - plain_likeness(a, b)) < 1e-9 and abs(got[i].near_next - plain_likeness(a, c)) < 1e-9
            done += 1
    assert done > 20
