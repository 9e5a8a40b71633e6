"""Whole-graph algorithms against plain loops."""

import random
from collections import defaultdict, deque

import pyarrow.parquet as pq
import pytest
from tidemill import graph_paths as gp


def some(n=60, m=75, seed=4):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)] + [("hub", f"n{k:02d}") for k in range(0, n, 7)]


def both(spark, pairs):
    return spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "src string, dst string")


def frame(spark, ids, name):
    return spark.createDataFrame([(x,) for x in ids], f"{name} string")


@pytest.mark.parametrize("hub", [3, 10**6])
@pytest.mark.parametrize("each", [False, True])
def test_paths(spark, monkeypatch, hub, each):
    monkeypatch.setattr(gp, "HUB", hub)
    pairs = some()
    around = defaultdict(set)
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    sources = ["n03", "n40", "lonely"]
    dist = {}
    for s in sources:
        dist[s, s], todo = 0, deque([s])
        while todo:
            x = todo.popleft()
            for y in around[x]:
                if (s, y) not in dist and dist[s, x] < 4:
                    dist[s, y] = dist[s, x] + 1
                    todo.append(y)
    got = gp.shortest_paths(both(spark, pairs), frame(spark, [*sources, "n03", None], "node"), 4, each).collect()
    want = dict(dist)
    if not each:
        best = {}
        for (s, y), d in dist.items():
            best[y] = min(best.get(y, (9, "")), (d, s))
        want = {(s, y): d for y, (d, s) in best.items()}
    assert {(r.source, r.node): r.dist for r in got} == want and len(got) == len(want)
    for r in got:
        assert r.path[0] == r.source and r.path[-1] == r.node and len(r.path) == r.dist + 1
        assert all(b in around[a] for a, b in zip(r.path, r.path[1:], strict=False))
        if r.dist:
            assert r.path[-2] == min(x for x in around[r.node] if want.get((r.source, x)) == r.dist - 1)


@pytest.mark.parametrize("hub", [3, 10**6])
def test_pagerank(spark, monkeypatch, hub):
    monkeypatch.setattr(gp, "HUB", hub)
    pairs = some()
    ids = sorted({x for p in pairs for x in p} | {"idle"})
    edges = [(a, b) for p in pairs for a, b in (p, p[::-1])]
    degree = defaultdict(int)
    for a, _ in edges:
        degree[a] += 1
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(15):
        got = defaultdict(float)
        for a, b in edges:
            got[b] += rank[a] / degree[a]
        lost = sum(r for x, r in rank.items() if not degree[x])
        rank = {x: 0.15 / len(ids) + 0.85 * (got[x] + lost / len(ids)) for x in ids}
    found = {r["node"]: r["rank"] for r in gp.pagerank(both(spark, pairs), frame(spark, ids, "id"), 15).collect()}
    assert found.keys() == rank.keys() and all(abs(found[x] - rank[x]) < 1e-12 for x in ids)
    assert abs(sum(found.values()) - 1) < 1e-9


def test_pagerank_stops_when_nothing_moves(spark, monkeypatch):
    made = []
    monkeypatch.setattr(gp, "cut", lambda df, name, f=gp.cut: made.append(name) or f(df, name))
    ring = [("a", "b"), ("b", "c"), ("c", "a")]
    found = gp.pagerank(both(spark, ring), frame(spark, "abc", "id"), 50, least_change=1e-9).collect()
    assert made.count("ranks") == 2 and all(abs(r["rank"] - 1 / 3) < 1e-12 for r in found)


@pytest.mark.parametrize("hub", [3, 10**6])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(gp, "HUB", hub)
    pairs = [*some(m=40), *[(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)], ("x", "x")]
    ids = {x for p in pairs for x in p} | {"alone"}
    parent = {x: x for x in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in gp.components(both(spark, pairs), frame(spark, ids, "id")).collect()}
    assert got == {x: root(x) for x in ids}


def test_empty(spark):
    none = both(spark, [("a", "b")]).limit(0)
    assert gp.pagerank(none, frame(spark, "a", "id").limit(0)).count() == 0
    assert [tuple(r) for r in gp.components(none, frame(spark, "a", "id")).collect()] == [("a", "a")]
    assert gp.shortest_paths(none, frame(spark, "a", "node"), 2).collect()[0]["path"] == ["a"]
    with pytest.raises(ValueError, match="negative"):
        gp.shortest_paths(none, frame(spark, "a", "node"), -1)


def test_no_round_shuffles_edges(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges, degrees = gp._salted(spark.range(200).selectExpr("id % 7 as src", "id as dst"), "probe")
        state = degrees.select("src", "parts")
        plan = gp._sent(state, edges)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and gp._sent(state, edges).count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nodes_are_never_broadcast(spark, tmp_path):
    spark.range(9).selectExpr("id as src", "id + 1 as dst").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    kept = gp._between(e, e.select("src").distinct())
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 8


def test_components_go_beyond_six_edges(spark):
    e = spark.range(40).selectExpr("explode(array(struct(id as src, id + 1 as dst), struct(id + 1 as src, id as dst))) as x").select("x.*")
    found = gp.components(e, spark.range(41))
    assert {(r.node, r.component) for r in found.collect()} == {(k, 0) for k in range(41)}


def ranked(pairs, ids, rounds):
    known = [(a, b) for a, b in pairs if a in ids and b in ids]
    edges = [e for a, b in known for e in ((a, b), (b, a))]
    degree = defaultdict(int)
    for a, _ in edges:
        degree[a] += 1
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        got = defaultdict(float)
        for a, b in edges:
            got[b] += rank[a] / degree[a]
        lost = sum(r for x, r in rank.items() if not degree[x])
        rank = {x: 0.15 / len(ids) + 0.85 * (got[x] + lost / len(ids)) for x in ids}
    return rank


@pytest.mark.parametrize(("block", "piece"), [(30, 10**6), (30, 50)])
def test_pagerank_over_blocks_and_pieces(spark, monkeypatch, block, piece):
    """Several blocks, hubs dealt over pieces, unknown and null ends, repeated nodes, rows that stand for several edges."""
    monkeypatch.setattr(gp, "BLOCK_NODES", block, raising=False)
    monkeypatch.setattr(gp, "PIECE_EDGES", piece, raising=False)
    pairs = [*some(), ("n01", "unknown"), ("gone", "n02"), ("x", "x"), *[("hub", f"n{k:02d}") for k in range(60)]]
    ids = {*(f"n{k:02d}" for k in range(60)), "hub", "x", "idle"}
    want = ranked(pairs, ids, 2)
    listed = frame(spark, [*ids, "n05", None], "id")
    counted = spark.createDataFrame([*[(*p, pairs.count(p)) for p in sorted(set(pairs))], (None, "n03", 1)], "source string, target string, n int")
    for adj in (both(spark, pairs), counted):
        found = {r["node"]: r["rank"] for r in gp.pagerank(adj, listed, 2).collect()}
        assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-12 for x in ids)


def test_pagerank_shuffles_no_row_for_an_edge(spark, monkeypatch):
    """A round shuffles one row for each piece and block, not one for each far end or more."""
    monkeypatch.setattr(gp, "BLOCK_NODES", 100, raising=False)
    plans = []

    def cut(df, name, f=gp.cut):
        plans.append((name, df))
        return f(df, name)

    monkeypatch.setattr(gp, "cut", cut)
    e = spark.range(3000).selectExpr("id % 300 as src", "(id * 7) % 300 as dst")
    gp.pagerank(e.union(e.selectExpr("dst", "src")), spark.range(300), 2)
    last = [df for name, df in plans if name == "ranks"][-1]._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in last and "HashAggregate" not in last and last.count("FileScan parquet spark_catalog") <= 1
    cells = [t.name for t in spark.catalog.listTables() if t.name.startswith("rank_cells")]
    assert any(spark.table(t).where("target >= 0").count() == 9 for t in cells)


def rounds_of_paths(spark, monkeypatch, pairs, sources, hops):
    plans = []
    monkeypatch.setattr(gp, "cut", lambda df, name, f=gp.cut: plans.append((name, df)) or f(df, name))
    found = gp.shortest_paths(both(spark, pairs), frame(spark, sources, "node"), hops)
    return found, [df for name, df in plans if name == "paths"][1:]


def test_a_round_of_paths_reads_no_row_for_every_node(spark, monkeypatch):
    """Besides the lists of edges it reads what was reached before, and hubs."""
    monkeypatch.setattr(gp, "HUB", 20)
    _, rounds = rounds_of_paths(spark, monkeypatch, [("a", "b"), ("b", "c"), *[("c", f"n{k:03d}") for k in range(300)]], ["a"], 2)
    files = {f.removeprefix("file://") for f in rounds[0].inputFiles() if "_lists_" not in f}
    assert files and sum(pq.read_metadata(f).num_rows for f in files) <= 2


def test_edges_are_counted_in_few_buckets(spark, monkeypatch):
    """What tells hubs shuffles a row for a bucket of nodes, not for a node; who shares a hub's bucket keeps all edges."""
    monkeypatch.setattr(gp, "HUB", 400)
    plans = []
    monkeypatch.setattr(gp, "cut", lambda df, name, f=gp.cut: plans.append((name, df)) or f(df, name))
    pairs = [*[("hub", f"n{k:04d}") for k in range(1000)], *[(f"n{k:04d}", f"m{k % 7}") for k in range(1000)]]
    found = gp.shortest_paths(both(spark, pairs), frame(spark, ["hub"], "node"), 2).collect()
    assert sorted((r.node, r.dist) for r in found) == sorted([("hub", 0), *[(f"n{k:04d}", 1) for k in range(1000)], *[(f"m{k}", 2) for k in range(7)]])
    counts = [df._jdf.queryExecution().executedPlan().toString() for name, df in plans if name not in ("paths", "path-edges")]
    assert counts and not any("hashpartitioning(src" in plan for plan in counts)
    lists = [t.name for t in spark.catalog.listTables() if t.name.startswith("path_lists")]
    assert any(spark.table(t).where("src = 'hub'").selectExpr("count(*) > 1", "sum(size(dsts)) = 1000").first() == (True, True) for t in lists)
