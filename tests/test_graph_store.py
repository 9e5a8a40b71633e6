"""The kept graph and tables that are built once."""

import pytest
from tidemill import graph as g
from tidemill import graph_store, kept, registry
from tidemill.plans import graph_queries


def physical(df):
    return df._jdf.queryExecution().toString().split("Physical Plan")[1]


def test_no_table_of_the_schema_is_read_again(spark, sf, tmp_path):
    k = graph_store.star_graph(spark, sf)
    near = k.at("customer_7")
    plan = physical(near)
    assert "lineitem" not in plan and "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(src,customer_7)" in plan
    for name in ("g_neighbors_1hop", "g_same_type_2hop", "g_neighbors_report_2hop"):
        assert "lineitem" not in physical(registry.QUERIES[name](spark, sf))


def test_a_hop_from_a_set_opens_its_folders_alone(spark, sf):
    k = graph_store.star_graph(spark, sf)
    far = g.two_hops(k.nodes, k.edges, "part_7", "HAS_PROJECT", near=k.at("part_7"))
    assert "dynamicpruning" in physical(far)


@pytest.mark.parametrize("rows", [1, 2_000_000])
def test_hubs_lie_in_several_files(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(graph_store, "FILE_ROWS", rows)
    monkeypatch.setattr(graph_store, "BUCKETS", 2)
    n = spark.createDataFrame([("hub", "t", "Hub", 0)] + [(f"n{i}", "t", f"N{i}", i + 1) for i in range(50)], "id string, type string, name string, ord long")
    e = spark.createDataFrame([("hub", f"n{i}", "R", "", 1.0, "", i) for i in range(50)], "source string, target string, relation string, status string, amount double, priority string, ord long")
    graph_store.write(n, e, str(tmp_path / "g"), 50)
    k = graph_store.opened(spark, str(tmp_path / "g"))
    hub = k.edges.where("src = 'hub'")
    assert hub.count() == 50 and k.edges.count() == 100 and k.nodes.count() == 51
    files = hub.selectExpr("input_file_name() as f").distinct().count()
    assert files > 5 if rows == 1 else files == 1


def test_once_builds_anew_when_files_change(spark, tmp_path):
    table, built = str(tmp_path / "t.parquet"), []

    def build(place):
        built.append(place)
        spark.read.parquet(table).write.parquet(place)

    spark.range(3).write.parquet(table)
    kept.forget(spark, "probe")
    first = kept.once(spark, "probe", [table], build)
    assert kept.once(spark, "probe", [table], build) == first and len(built) == 1
    spark.range(4).write.mode("append").parquet(table)
    second = kept.once(spark, "probe", [table], build)
    assert second != first and spark.read.parquet(second).count() == 7 and spark.read.parquet(first).count() == 3
    with pytest.raises(ZeroDivisionError):  # a failed build leaves nothing under the name
        spark.range(5).write.mode("append").parquet(table)
        kept.once(spark, "probe", [table], lambda place: 1 / 0)
    assert kept.forget(spark, "probe") == 2


def test_a_lost_race_keeps_the_winner(spark, tmp_path):
    table = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(table)

    def slow(place):
        kept.once(spark, "race", [table], lambda p: spark.range(1).write.parquet(p))  # another builder is done first
        spark.range(2).write.parquet(place)

    assert spark.read.parquet(kept.once(spark, "race", [table], slow)).count() == 1
    assert kept.forget(spark, "race") == 1


def test_kept_and_built_graphs_answer_alike(spark, sf):
    k = graph_store.star_graph(spark, sf)
    n, e = graph_queries.s.nodes(spark, sf), graph_queries.s.edges(spark, sf)
    for kind in ("part", "customer", "supplier"):
        rows = [[tuple(r) for r in g.neighbors(a, b, "customer_11", target_type=kind).collect()] for a, b in ((n, e), (k.nodes, k.edges))]
        assert [r[:8] for r in rows[0]] == [r[:8] for r in rows[1]] and rows[0]


SOME = ["customer_7", "part_7", "supplier_3", "nation_1", "order_5", "customer_007", "x", "part_99999999999999999999", "", "customer_-1"]


def test_edges_at_nodes_are_those_of_the_whole_graph(spark, sf):
    some = spark.createDataFrame([(x,) for x in [*SOME, *SOME[:2], None]], "src string")
    whole = graph_queries.s.adjacency(graph_queries.s.edges(spark, sf))
    want = whole.where(whole.src.isin(SOME))
    found = graph_store.TableGraph(spark, sf).starting(some)
    assert found.count() == want.count() > 100 and found.columns == want.columns
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_a_question_builds_no_graph(spark, sf):
    kept.forget(spark, "graph")
    for name in ("g_neighbors_1hop", "g_neighbors_2hop", "g_neighbors_report_default", "g_same_type_2hop", "g_paths_nearest"):
        assert registry.QUERIES[name](spark, sf).count()
    assert kept.forget(spark, "graph") == 0


def test_numbers_of_nodes_stand_for_their_names(spark, sf):
    s = graph_queries.s
    named = s.links(spark, sf).select(s.node_name(s.F.col("src")), s.node_name(s.F.col("dst")))
    whole = s.adjacency(s.edges(spark, sf)).select("src", "dst")
    assert named.exceptAll(whole).isEmpty() and whole.exceptAll(named).isEmpty()
