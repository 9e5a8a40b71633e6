"""Entity linking against plain loops."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tidemill import linking, registry
from tidemill.plans import graph_queries


def brute(texts, entities):
    names = {}
    for id_, name, _ in sorted(entities, key=lambda e: e[2]):
        if name:
            names[name.lower()] = id_
    out = []
    for key, text in texts:
        text = (text or "").lower()
        found = sorted((-len(n), p, n) for n in names for p in range(len(text)) if text.startswith(n, p))
        taken = set()
        for minus, p, n in found:
            if not taken & set(range(p, p - minus)):
                taken |= set(range(p, p - minus))
                out.append((key, p, -minus, names[n]))
    return sorted(out)


def got(df):
    return sorted((r.key, r.at, r.length, r.id) for r in df.collect())


def frames(spark, texts, entities):
    return spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(entities, "id string, name string, ord long")


def some():
    rng = random.Random(9)
    entities = [("a", "Client-A", 1), ("ab", "Client-AB", 2), ("x", "aa", 3), ("y", "aaa", 4), ("z", "AA", 9), ("e", "", 5), ("n", None, 6), ("k", "한국어", 7), ("s", "😀 é", 8), ("one", "q", 10)]
    texts = [(1, "client-ab and Client-A, CLIENT-AB."), (2, "aaaaaaaa"), (3, None), (4, ""), (5, "x한국어y😀 É"), (6, "none"), (7, "q" * 300)]
    return texts + [(10 + k, "".join(rng.choice("aqcb-") for _ in range(rng.randrange(60)))) for k in range(60)], entities


@pytest.mark.parametrize("full", [False, True])
def test_links(spark, monkeypatch, full):
    if full:  # where every stretch passes the sieve, the join alone decides
        monkeypatch.setattr(linking, "_passes", lambda words, keys: np.ones(len(keys), bool))
    texts, entities = some()
    t, e = frames(spark, texts, entities)
    want = brute(texts, entities)
    assert got(linking.link(t, "text", ["key"], e)) == want and len(want) > 30
    first = {}
    for key, at, length, id_ in want:
        first[key] = min(first.get(key, (0, 0, 0)), (-length, at, id_))
    found = {r.key: (-r.length, r.at, r.id) for r in linking.first_entity(t, "text", ["key"], e).collect()}
    assert found.keys() == first.keys() and all(found[k][0] == first[k][0] for k in found)


def test_empty(spark):
    texts, entities = some()
    t, e = frames(spark, texts, entities)
    assert linking.link(t.limit(0), "text", ["key"], e).count() == 0
    assert linking.link(t, "text", ["key"], e.limit(0)).count() == 0


def test_all_conversations(spark):
    sf = "/root/testdata/sf0.01"
    turns = [((r.conv_id, r.turn), r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    known = [tuple(r) for r in graph_queries.entities(spark, sf).where("id like 'phrase%' or id like 'part%' or id like 'nation%'").collect()]
    found = sorted(((r.conv_id, r.turn), r.at, r.length, r.id) for r in registry.QUERIES["g_linked_entities"](spark, sf).collect())
    assert found == brute(turns, known) and len(found) > 100


def test_candidates_are_never_broadcast(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    plan = linking.matches(turns, "text", ["conv_id", "turn"], graph_queries.entities(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_full_sieves_make_no_large_batches(monkeypatch):
    monkeypatch.setattr(linking, "CANDIDATES", 50, raising=False)
    everything = np.full(1 << 10, (1 << 64) - 1, np.uint64)
    texts = ["abcdefghijklmnopqrstuvwxyz"[k % 7 :] for k in range(40)]
    keys, schema = ["key"], pa.schema([("key", pa.int64()), ("at", pa.int64()), ("name", pa.string())])
    shared = SimpleNamespace(value=([3, 8, 12], everything, everything))
    made = list(linking._propose(shared, keys, schema)(iter([pa.RecordBatch.from_pydict({"key": list(range(40)), "_text": texts})])))
    assert max(b.num_rows for b in made) < 50 + 26
    got = [r for b in made for r in zip(*b.to_pydict().values(), strict=True)]
    assert got == [(k, p, t[p : p + n]) for k, t in enumerate(texts) for n in (3, 8, 12) for p in range(len(t) - n + 1)]


def test_many_names_that_begin_alike_let_little_pass(spark, monkeypatch):
    """Three names for a place of the sieve, as with tens of millions of names."""
    monkeypatch.setattr(linking, "LEAST_BITS", 12)
    monkeypatch.setattr(linking, "MOST_BITS", 12)
    names = spark.range(12_000).selectExpr("concat('client#', id) as name")
    heads = linking._sieve(names.selectExpr("substring(name, 1, 8) as name").distinct())
    wholes = linking._sieve(names.where("length(name) > 8"))
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef ") for _ in range(400)) + "client#77 client#11999" for _ in range(20)]
    found = [{t[p : p + n] for n, places in linking._places(t, range(8, 13), heads, wholes) for p in places} for t in texts]
    assert all({"client#7", "client#77", "client#11999"} <= x for x in found) and sum(map(len, found)) < 20 * 100


@pytest.mark.parametrize("n", [1, 7, 8, 9, 30])
def test_lengths_about_a_head(spark, n):
    name = "abcdefghijklmnopqrstuvwxyzäöü한"[:n]
    texts, entities = [(1, name), (2, "x" + name.upper() + name), (3, name[:-1]), (4, name[1:])], [("a", name, 1), ("b", "abcdefgh#", 2)]
    t, e = frames(spark, texts, entities)
    assert got(linking.link(t, "text", ["key"], e)) == brute(texts, entities)


def test_matches_of_few_texts_are_settled_at_once(spark, sf):
    """Texts and the lists of their matches reach Python 500 at a time, not 10,000."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    linked = registry.QUERIES["g_linked_entities"](spark, sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert "ArrowEvalPython" not in linked._jdf.queryExecution().executedPlan().toString()


def test_settles_batches_of_several_texts(spark):
    keys, schema = ["key"], pa.schema([("key", pa.int64()), ("at", pa.int64()), ("length", pa.int32()), ("id", pa.string())])
    one = [{"at": a, "length": n, "id": f"{a}-{n}"} for a, n in ((0, 2), (1, 3), (4, 2), (3, 3), (0, 1), (9, 1))]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int32()), ("id", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([one[:1], one, one[4:], one[::-1]], kind)], ["key", "found"])
    for skipped in (0, 1):
        (out,) = linking._settle(keys, schema)(iter([batch.slice(skipped)]))
        rows = sorted(zip(*out.to_pydict().values(), strict=True))
        six = [(0, 1, "0-1"), (1, 3, "1-3"), (4, 2, "4-2"), (9, 1, "9-1")]
        want = [(1, 0, 2, "0-2"), *[(2, *x) for x in six], (3, 0, 1, "0-1"), (3, 9, 1, "9-1"), *[(4, *x) for x in six]]
        assert rows == want[skipped:]


def test_candidates_leave_python_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(linking, "LEAST_BITS", 6)
    monkeypatch.setattr(linking, "MOST_BITS", 6)
    propose = linking._propose

    def watched(*args):
        run = propose(*args)

        def checked(batches):
            for batch in run(batches):
                assert batch.num_rows <= 40_000, batch.num_rows
                yield batch

        return checked

    monkeypatch.setattr(linking, "_propose", watched)
    t = spark.range(500).selectExpr("id as key", "concat(repeat('abcdefghij', 30), 'xyz-', id) as text")
    e = spark.range(2000).selectExpr("concat('e', id) as id", "concat('xyz-', id) as name", "id as ord")
    e = e.union(spark.range(10).selectExpr("concat('q', id)", "concat(repeat('q', int(id) + 1))", "id"))
    assert {(r.key, r.id) for r in linking.link(t, "text", ["key"], e).collect()} == {(k, f"e{k}") for k in range(500)}
