from collections import defaultdict

import pytest
from tidemill.llm.mixing import mix, mixed_sizes, op5_mixing, oracle

from . import duck

COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards"]


def fill(sizes):
    """Targets by the rule: share by weight, stop at the caps, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, live = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while live:
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in live}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        live -= over
    return target


def check(rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    want = fill(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s], 0)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    df = op5_mixing(spark, sf)
    rows = df.collect()
    check(rows)
    got = sorted([tuple(r[c] for c in COLUMNS) for r in rows], key=str)
    assert got == duck.rows(oracle(), sf, COLUMNS)
    assert got == sorted([tuple(r[c] for c in COLUMNS) for r in op5_mixing(spark, sf).collect()], key=str)
    shards = [s for r in rows for s in r.shards.split(",") if r.shards]
    assert len(set(shards)) == 8 and len(shards) == sum(r.copies for r in rows)


def test_edges(spark):
    rows = [(k, "w " * (k % 37 + 1), None if k % 3 == 0 else f"s{k % 5}") for k in range(400)]
    rows += [(1, None, "s1"), (2, "", "none"), (None, "a b", "s2"), (None, "a b", "s2"), (3, "x", "é"), (900, "y " * 20_000, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as block", "3 as key", "4 as target")
    got = mixed_sizes(df).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixed_sizes(df.limit(0)).count() == 0
    out = mix(df)
    assert out.columns[:7] == df.columns
    assert out.where("text is not null and doc_id = 900").count() in (0, 1, 2)


def test_mix_repeats_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixed_sizes(docs).collect()}
    assert {r.doc_id: r["count"] for r in mix(docs).groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
