"""Golden cases on a small graph, by hand."""

import json

import pytest
from pyspark.sql import functions as F
from tidemill import graph as g
from tidemill import sources

CATALOGUE = {
    "USES": ("client", "product", False, ("status",)),
    "HAS_PROJECT": ("client", "project", False, ()),
    "LEADS": ("employee", "project", False, ()),
    "MANAGES_ACCOUNT": ("employee", "client", False, ()),
    "REPORTED_ISSUE": ("client", "product", True, ("priority",)),
}
NODES = [("c1", "client", "Alpha", {"region": "North"}), ("c2", "client", "Beta", {}), ("p1", "product", "Gear", {}), ("p2", "product", "Gear Pro", {}), ("e1", "employee", "Kim", {}), ("e2", "employee", "Kim", {}), ("j1", "project", "Move", {"status": "in_progress"})]
EDGES = [
    ("c1", "p1", "USES", "active", 100.0, None), ("c1", "p1", "USES", "cancelled", 50.0, None), ("c2", "p1", "USES", "completed", 10.0, None), ("c2", "p2", "USES", "active", 0.0, None), ("c2", "j1", "HAS_PROJECT", None, None, None),
    ("e1", "j1", "LEADS", None, None, None), ("e1", "c1", "MANAGES_ACCOUNT", None, None, None), ("e2", "c2", "MANAGES_ACCOUNT", None, None, None), ("c1", "p2", "REPORTED_ISSUE", None, None, "high"), ("c1", "p2", "REPORTED_ISSUE", None, None, "critical"),
]


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([(k, *x) for k, x in enumerate(NODES)], "ord long, id string, type string, name string, props map<string,string>").cache()
    e = spark.createDataFrame([(*x, k) for k, x in enumerate(EDGES)], "source string, target string, relation string, status string, amount double, priority string, ord long").cache()
    return n, e


def shown(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_one_hop(small):
    n, e = small
    active = g.neighbors(n, e, "c1", "USES", "product", edge_filter={"status": "active"})
    assert shown(active, "id", "link_count", "contract_amount", "contract_status") == [("p1", 1, 100.0, "active")]
    assert g.excluded(e, "c1", "USES", {"status": "active"}).first()[0] == 1
    assert shown(g.neighbors(n, e, "c1", "USES", "product"), "id", "link_count", "contract_amount", "contract_status") == [("p1", 2, 150.0, "active")]
    assert shown(g.neighbors(n, e, "c2", "USES", "product", edge_filter={"status": "ACTIVE"}), "id", "contract_amount") == [("p2", 0.0)]
    assert shown(g.neighbors(n, e, "c1", None, "product"), "name", "link_count", "top_priority", "issue_count") == [("Gear", 2, None, 0), ("Gear Pro", 2, "critical", 2)]


def test_two_hops(small):
    n, e = small
    assert shown(g.neighbors(n, e, "p1", None, "project"), "id", "via", "hops") == [("j1", "Beta", 2)]
    assert shown(g.neighbors(n, e, "p2", None, "project"), "id", "via", "hops") == [("j1", "Beta", 2)]
    assert shown(g.neighbors(n, e, "c1", "MANAGES_ACCOUNT", "client"), "id") == []
    assert shown(g.neighbors(n, e, "p1", "USES", "project", edge_filter={"status": "active"}), "id") == []


def test_rank_and_ties(small):
    n, e = small
    assert shown(g.rank(n, e, "USES", "client"), "name", "link_count", "distinct_count") == [("Alpha", 2, 1), ("Beta", 2, 2)]
    assert sorted(shown(g.tied_top(n, e, "USES", "client"), "name", "tied_count")) == [("Alpha", 2), ("Beta", 2)]
    assert shown(g.rank(n, e, "USES", "client", edge_filter={"status": "active"}), "name", "link_count") == [("Alpha", 1), ("Beta", 1)]
    assert shown(g.rank(n, e, "REPORTED_ISSUE", "client", ascending=True), "name", "link_count") == [("Alpha", 2)]
    assert g.tied_top(n, e, "REPORTED_ISSUE", "client").count() == 0


def test_scan_and_filters(small):
    n, e = small
    assert shown(g.scan(n, e, "LEADS", "employee", {"status": "In_Progress"}), "id", "via") == [("e1", "Move")]
    assert g.scan(n, e, "LEADS", "employee", {"status": "done"}).count() == 0
    assert shown(n.where(g.node_passes({"region": "NORTH"})), "id") == [("c1",)]
    assert n.where(g.node_passes({"missing": ""})).count() == len(NODES)
    kept = e.where(g.edge_passes({"status": "active", "priority": "high"}, CATALOGUE))
    assert kept.where("relation in ('USES', 'REPORTED_ISSUE')").count() == 3


def test_resolve(small, spark):
    n, _ = small
    terms = spark.createDataFrame([(t,) for t in ("Kim", " gear ", "gea", "E1", "nobody", "lph", "")], "term string")
    got = {r.term: (r.how, r.id, r.candidates) for r in g.resolve(n, terms).collect()}
    assert got["Kim"] == ("name", "e2", None) and got[" gear "] == ("name", "p1", None) and got["E1"] == ("id", "e1", None)
    assert got["gea"] == ("ambiguous", None, "Gear;Gear Pro") and got["lph"] == ("part", "c1", None)
    assert got["nobody"][0] == got[""][0] == "none"


def test_clamp():
    assert [g.clamp(k) for k in (0, 1, 10, 999)] == [1, 1, 10, 30]


def test_json_sources(spark, tmp_path):
    (tmp_path / "n.json").write_text('[{"id": "a", "type": "t", "name": "A", "properties": {"k": 1}}, {"id": "b", "type": "t", "name": "B"}]')
    (tmp_path / "e.json").write_text('[{"source": "a", "target": "b", "relation": "USES", "properties": {"status": "active", "amount": 5}}, {"source": "b", "target": "a", "relation": "LEADS"}]')
    n, e = sources.read_graph_json(spark, str(tmp_path / "n.json"), str(tmp_path / "e.json"))
    assert [(r.ord, r.id, r.props) for r in n.orderBy("ord").collect()] == [(0, "a", {"k": "1"}), (1, "b", {})]
    assert [(r.ord, r.status, r.amount) for r in e.orderBy("ord").collect()] == [(0, "active", 5.0), (1, None, None)]
    assert sources.adjacency(e).where(F.col("src") == "a").count() == 2


def test_neighbors_and_excluded_are_all_edges(small):
    n, e = small
    for anchor in ("c1", "c2", "p1"):
        for status in ("active", "cancelled", "none"):
            links = sum(r.link_count for r in g.hop(e, anchor, "USES", {"status": status}).collect())
            whole = sum(r.link_count for r in g.hop(e, anchor, "USES").collect())
            assert links + g.excluded(e, anchor, "USES", {"status": status}).first()[0] == whole


def test_requests_are_settled():
    assert g.settled("USES") == ("USES", {"status": "active"})
    assert g.settled("USES", all_edges=True) == ("USES", None)
    assert g.settled("USES", edge_filter={"status": "cancelled"}) == ("USES", {"status": "cancelled"})
    assert g.settled(None, edge_filter={"priority": "high"}) == ("REPORTED_ISSUE", {"priority": "high"})
    assert g.settled("LEADS", "part", "customer") == (None, None) and g.settled("LEADS", "part", "supplier") == ("LEADS", None)
    assert g.settled(None, edge_filter={"colour": "red"}) == (None, {"colour": "red"})
    assert g.endpoints_ok("LEADS", "order") and not g.endpoints_ok("LEADS", "part") and g.endpoints_ok("LEADS", None)


def test_rows_are_flat_and_sparse(small, spark):
    n, e = small
    rows = lambda *args, **more: [json.loads(r.row) for r in g.neighbor_rows(n, e, *args, **more).collect()]
    assert rows("p1", None, "project") == [{"id": "j1", "type": "project", "name": "Move", "status": "in_progress", "relation": "HAS_PROJECT", "via": "Beta"}]
    assert rows("c1", None, "product") == [
        {"id": "p1", "type": "product", "name": "Gear", "relation": "USES", "link_count": 2, "contract_amount": 150.0, "contract_status": "active"},
        {"id": "p2", "type": "product", "name": "Gear Pro", "relation": "REPORTED_ISSUE", "link_count": 2, "top_priority": "critical", "issue_count": 2},
    ]
    assert rows("c2", "USES", "product", edge_filter={"status": "active"})[0]["contract_amount"] == 0.0
    assert rows("j1", "USES", "employee", node_filter={"region": "none"}) == []
    clash = spark.createDataFrame([(0, "a", "t", "A", {"name": "other", "relation": "x", "via": "kept", "q": '"}'}), (1, "b", "t", "B", None)], n.schema)
    link = spark.createDataFrame([("b", "a", "LEADS", None, None, None, 0)], e.schema)
    assert [json.loads(r.row) for r in g.neighbor_rows(clash, link, "b").collect()] == [{"id": "a", "type": "t", "name": "other", "relation": "LEADS", "via": "kept", "q": '"}'}]
    assert {r.id: r.fields for r in g.flat(clash).collect()}["b"] == {"id": "b", "type": "t", "name": "B"}


def test_the_far_step_reads_only_what_it_can_use(spark, sf):
    n, near = sources.nodes(spark, sf, ("order",)), sources.edges(spark, sf, anchor="part_7")
    scans = lambda e: g.two_hops(n, e, "part_7", "HAS_PROJECT", {"status": "active"}, near)._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert scans(sources.edges(spark, sf)) == scans(sources.edges(spark, sf, ("HAS_PROJECT",)))


def test_whole_joins_are_dealt_by_their_size(spark, sf, monkeypatch):
    want = sorted(map(tuple, sources.edges(spark, sf).drop("ord").collect()), key=str)
    monkeypatch.setattr(sources, "JOINED_LINES", 500, raising=False)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    plan = sources.edges(spark, sf, ("USES",))._jdf.queryExecution().toString()
    assert "hashpartitioning(l_orderkey" in plan and f", {-(-lines // 500)}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, sources.edges(spark, sf).drop("ord").collect()), key=str) == want
    assert "REPARTITION_BY_NUM" not in sources.edges(spark, sf, ("USES",), anchor="part_7")._jdf.queryExecution().toString()
