"""Graph operators: entity resolution, one- and two-hop neighbours, degree ranking and conditional scans.

Builders of DataFrames; only neighbors() runs a job, which stops at the first row, to see whether one hop is enough. With
a TableGraph in place of edges, the far step of two hops runs jobs as well, which write the edges at the middle nodes.
Anchors and terms are literals or small frames of the caller; edges are never collected. Edges without a node at their end are left out by the joins.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph_store import TableGraph, bucket
from .kept import cut
from .sources import RELATIONS, adjacency

MOST, DEFAULT = 30, 10
#: The least ratio of a close match; terms that are compared with all names in one call.
CLOSE, MOST_TERMS = 0.6, 10_000
PRIORITIES = ("low", "medium", "high", "critical")


def clamp(top_k: int) -> int:
    return max(1, min(int(top_k), MOST))


def edge_passes(edge_filter: dict | None, catalogue: dict = RELATIONS) -> Column:
    """Whether an edge meets the filter; a key its relation has no such attribute for does not count against it."""
    tests = []
    for key, value in (edge_filter or {}).items():
        owners = [r for r, x in catalogue.items() if key in x[3]]
        if owners:
            tests.append(~F.col("relation").isin(owners) | (F.lower(F.coalesce(key, F.lit(""))) == value.lower()))
    return reduce(Column.__and__, tests, F.lit(True))


def node_passes(node_filter: dict | None) -> Column:
    tests = [F.lower(F.coalesce(F.col("props")[k], F.lit(""))) == str(v).lower() for k, v in (node_filter or {}).items()]
    return reduce(Column.__and__, tests, F.lit(True))


def relation_passes(relation: str | None, events: bool, catalogue: dict = RELATIONS) -> Column:
    if relation:
        return F.col("relation") == relation
    return F.lit(True) if events else ~F.col("relation").isin([r for r, x in catalogue.items() if x[2]] or [""])


def summary() -> list[Column]:
    """What parallel edges to one node collapse to."""
    status, priority = F.when(F.col("status") != "", F.col("status")), F.when(F.col("priority") != "", F.col("priority"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITIES)), priority), F.lit(0))
    return [
        F.min_by("relation", "ord").alias("relation"),
        F.min_by("direction", "ord").alias("direction"),
        F.count("*").alias("link_count"),
        F.sum("amount").alias("contract_amount"),
        F.when(F.max((status == "active").cast("int")) == 1, "active").otherwise(F.min_by(status, F.when(status.isNotNull(), F.col("ord")))).alias("contract_status"),
        F.min_by(priority, F.when(priority.isNotNull(), F.struct(-place, F.col("ord")))).alias("top_priority"),
        F.count(priority).alias("issue_count"),
        F.min("ord").alias("first"),
    ]


def hop(e: DataFrame, anchor: str, relation: str | None, edge_filter: dict | None = None) -> DataFrame:
    """dst with summed-up edges, one hop from the anchor; events count."""
    near = adjacency(e).where((F.col("src") == anchor) & relation_passes(relation, True) & edge_passes(edge_filter))
    return near.groupBy("dst").agg(*summary(), F.lit(None).cast("string").alias("via"))


def _from(e: DataFrame | TableGraph, some: DataFrame, passes: Column) -> DataFrame:
    """The passing edges that start at some nodes (src); of a kept adjacency only the folders of those nodes are opened, of
    a graph in tables only the rows with their keys."""
    if isinstance(e, TableGraph):
        some = cut(some, "mids")
        return e.starting(some).where(passes).join(some, "src")
    adj = adjacency(e).where(passes)
    if "bucket" in adj.columns:
        return adj.join(some.withColumn("bucket", bucket(F.col("src"))), ["bucket", "src"]).drop("bucket")
    return adj.join(some, "src")


def two_hops(n: DataFrame, e: DataFrame, anchor: str, relation: str | None, edge_filter: dict | None = None, near: DataFrame | None = None) -> DataFrame:
    """dst at two hops: the middle by any relation but events, the last step by the given one. The first middle node, in
    the order of its edges, that leads to a node gives its edges and `via`. near: the edges at the anchor, where known."""
    near = e.at(anchor) if near is None and isinstance(e, TableGraph) else near
    mids = adjacency(e if near is None else near).where(edge_passes(edge_filter)).where((F.col("src") == anchor) & relation_passes(None, False)).groupBy("dst").agg(F.min("ord").alias("mid_ord"))
    named = mids.join(n.select(F.col("id").alias("dst"), F.col("name").alias("via")), "dst").withColumnRenamed("dst", "src")
    far = _from(e, named, edge_passes(edge_filter) & relation_passes(relation, False)).where(F.col("dst") != anchor)
    paths = far.groupBy("dst", "src", "via", "mid_ord").agg(*summary())
    first = Window.partitionBy("dst").orderBy("mid_ord", "src")
    return paths.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first", "src").withColumn("first", F.col("first")).drop("mid_ord")


def _found(n: DataFrame, e: DataFrame, anchor: str, relation: str | None, target_type: str | None, node_filter: dict | None, edge_filter: dict | None, top_k: int, near: DataFrame | None) -> DataFrame:
    """The rows of neighbors, unsorted, with the column `first` that settles their order."""
    keep = n.where((F.col("type") == target_type if target_type else F.lit(True)) & node_passes(node_filter)).select(F.col("id").alias("dst"), "type", "name")
    near = e.at(anchor) if near is None and isinstance(e, TableGraph) else near
    rows = hop(e if near is None else near, anchor, relation, edge_filter).join(keep, "dst").withColumn("hops", F.lit(1))
    if target_type is not None:
        rows = rows.persist()  # what the test reads is not made again for the result
    if target_type is not None and rows.isEmpty():
        rows.unpersist()
        rows = two_hops(n, e, anchor, relation, edge_filter, near).join(keep, "dst").withColumn("hops", F.lit(2))
    return rows.orderBy(*_order("dst")).limit(clamp(top_k)).withColumnRenamed("dst", "id")


def _order(key: str) -> list[Column | str]:
    return [F.desc("link_count"), "name", "first", key]


def neighbors(n: DataFrame, e: DataFrame, anchor: str, relation: str | None = None, target_type: str | None = None, node_filter: dict | None = None, edge_filter: dict | None = None, top_k: int = DEFAULT, near: DataFrame | None = None) -> DataFrame:
    """Nodes at one hop; where that gives none of a wanted type, at two. In the order of links, name and first sight.

    near: the edges at the anchor, if the caller can read them alone; e must hold all edges.
    """
    rows = _found(n, e, anchor, relation, target_type, node_filter, edge_filter, top_k, near)
    return rows.select("id", "type", "name", "relation", "direction", "via", "hops", "link_count", "contract_amount", "contract_status", "top_priority", "issue_count")


def flat(n: DataFrame) -> DataFrame:
    """id, fields: id, name and type of a node and its properties in one map; a property of such a name replaces it."""
    brief = F.create_map(*[x for c in ("id", "name", "type") for x in (F.lit(c), F.col(c))])
    own = F.coalesce("props", F.create_map().cast("map<string,string>"))
    return n.select("id", F.map_concat(F.map_filter(brief, lambda k, _: ~F.map_contains_key(own, k)), own).alias("fields"))


def neighbor_rows(n: DataFrame, e: DataFrame, anchor: str, relation: str | None = None, target_type: str | None = None, node_filter: dict | None = None, edge_filter: dict | None = None, top_k: int = DEFAULT, near: DataFrame | None = None) -> DataFrame:
    """id and row of neighbors() with the same arguments, in its order; row is a JSON object of one level.

    It has the node's flat fields, then what is known of its links, which replaces fields of the same name: relation; via if
    there is one; link_count above 1; amount, status, priority and number of issues if any edge has them.
    """
    rows = _found(n, e, anchor, relation, target_type, node_filter, edge_filter, top_k, near)
    only = lambda c, ok: F.when(ok, F.col(c)).alias(c)
    facts = F.to_json(F.struct("relation", only("via", F.col("via") != ""), only("link_count", F.col("link_count") > 1), "contract_amount", "contract_status", "top_priority", only("issue_count", F.col("issue_count") > 0)))
    x = flat(n).join(F.broadcast(rows.withColumn("facts", facts)), "id")  # at most MOST rows
    fields = F.to_json(F.map_filter("fields", lambda k, _: ~F.array_contains(F.json_object_keys("facts"), k)))
    whole = F.when(fields == "{}", F.col("facts")).otherwise(F.concat(F.expr("left(_fields, length(_fields) - 1)"), F.lit(","), F.substring("facts", 2, 1 << 30)))
    return x.withColumn("_fields", fields).orderBy(*_order("id")).select("id", whole.alias("row"))


def excluded(e: DataFrame, anchor: str, relation: str | None, edge_filter: dict) -> DataFrame:
    """excluded: edges at the anchor that fit the relation but not the filter."""
    return adjacency(e).where((F.col("src") == anchor) & relation_passes(relation, True)).agg(F.count_if(~edge_passes(edge_filter)).alias("excluded"))


def report(n: DataFrame, e: DataFrame, anchor: str, relation: str | None = None, target_type: str | None = None, node_filter: dict | None = None, edge_filter: dict | None = None, top_k: int = DEFAULT, near: DataFrame | None = None) -> DataFrame:
    """hops (0 for none found), total, returned, truncated and excluded of neighbors() with the same arguments, in one row.

    excluded: edges that fit in all but the edge filter, at the anchor and, where two hops were walked, again at the anchor
    among the middle steps and at the middle nodes. All counts are parts of one plan; no job runs here, but for a TableGraph.
    """
    near = e.at(anchor) if near is None and isinstance(e, TableGraph) else near
    ok, at = edge_passes(edge_filter), adjacency(e if near is None else near).where(F.col("src") == anchor)
    keep = n.where((F.col("type") == target_type if target_type else F.lit(True)) & node_passes(node_filter)).select(F.col("id").alias("dst"))
    parts = {"one": hop(e if near is None else near, anchor, relation, edge_filter).join(keep, "dst"), "out_one": at.where(relation_passes(relation, True) & ~ok)}
    if target_type is not None:
        middle = at.where(relation_passes(None, False))
        mids = middle.where(ok).select(F.col("dst").alias("src")).distinct()
        parts["two"] = two_hops(n, e, anchor, relation, edge_filter, near).join(keep, "dst")
        parts["out_two"] = middle.where(~ok).select("src").unionByName(_from(e, mids, relation_passes(relation, False) & ~ok).select("src"))
    counted = reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, x in parts.items()])
    of = lambda name: F.coalesce(F.max(F.when(F.col("part") == name, F.col("n"))), F.lit(0))
    x = counted.agg(*[of(name).alias(name) for name in ("one", "out_one", "two", "out_two")])
    near_by = F.col("one") > 0
    x = x.select(
        F.when(near_by, 1).when(F.col("two") > 0, 2).otherwise(0).alias("hops"),
        F.when(near_by, F.col("one")).otherwise(F.col("two")).alias("total"),
        (F.col("out_one") + F.when(near_by, F.lit(0)).otherwise(F.col("out_two"))).alias("excluded"),
    )
    returned = F.least("total", F.lit(clamp(top_k)).cast("long"))
    return x.select("hops", "total", returned.alias("returned"), (F.col("total") > returned).alias("truncated"), "excluded")


def endpoints_ok(relation: str, node_type: str | None, catalogue: dict = RELATIONS) -> bool:
    """Whether the relation may end at a node of that type; any may where no type is wanted."""
    return node_type is None or node_type in catalogue[relation][:2]


def settled(relation: str | None, target_type: str | None = None, anchor_type: str | None = None, edge_filter: dict | None = None, all_edges: bool = False, catalogue: dict = RELATIONS) -> tuple[str | None, dict | None]:
    """Relation and edge filter of a request once its gaps are filled.

    A relation that fits neither the wanted type nor the anchor's is dropped; USES without a filter means active ones, unless
    all are wanted; a filter alone means the one relation that has such attributes, if there is just one.
    """
    if relation and anchor_type and not endpoints_ok(relation, target_type, catalogue) and not endpoints_ok(relation, anchor_type, catalogue):
        relation = None
    if edge_filter is None:
        return relation, {"status": "active"} if relation == "USES" and not all_edges else None
    if relation is None:
        owners = [r for r, x in catalogue.items() if any(key in x[3] for key in edge_filter)]
        relation = owners[0] if len(owners) == 1 else None
    return relation, edge_filter


def degrees(n: DataFrame, e: DataFrame, relation: str, target_type: str, edge_filter: dict | None = None) -> DataFrame:
    """id, name, link_count, distinct_count of the nodes of a type that have such edges, before any cut."""
    adj = adjacency(e.where((F.col("relation") == relation) & edge_passes(edge_filter)))
    counted = adj.groupBy("src").agg(F.count("*").alias("link_count"), F.countDistinct("dst").alias("distinct_count"))
    return counted.join(n.where(F.col("type") == target_type).select(F.col("id").alias("src"), "name"), "src").withColumnRenamed("src", "id")


def rank(n: DataFrame, e: DataFrame, relation: str, target_type: str, ascending: bool = False, edge_filter: dict | None = None, top_k: int = DEFAULT) -> DataFrame:
    order = F.asc("link_count") if ascending else F.desc("link_count")
    return degrees(n, e, relation, target_type, edge_filter).orderBy(order, "name", "id").limit(clamp(top_k))


def tied_top(n: DataFrame, e: DataFrame, relation: str, target_type: str, ascending: bool = False, edge_filter: dict | None = None) -> DataFrame:
    """name, tied_count of all nodes that share the first place, over the whole ranking; empty if one stands alone."""
    d = degrees(n, e, relation, target_type, edge_filter)
    best = d.groupBy("link_count").agg(F.count("*").alias("n")).agg((F.min if ascending else F.max)(F.struct("link_count", "n")).alias("best")).select("best.*").where("n > 1")
    return d.join(F.broadcast(best.select("link_count")), "link_count").select("name", F.col("link_count").alias("tied_count"))  # one row


def scan(n: DataFrame, e: DataFrame, relation: str, target_type: str, far_filter: dict | None = None, edge_filter: dict | None = None, top_k: int = DEFAULT) -> DataFrame:
    """Nodes of a type at an end of the relation's edges whose other end meets the filter; the source end counts first."""
    chosen = e.where((F.col("relation") == relation) & edge_passes(edge_filter))
    brief = n.select("id", "type", "name", "props")
    ends = chosen.join(brief.select(*[F.col(c).alias(f"s_{c}") for c in brief.columns]), F.col("source") == F.col("s_id")).join(brief.select(*[F.col(c).alias(f"t_{c}") for c in brief.columns]), F.col("target") == F.col("t_id"))
    at_source = F.col("s_type") == target_type
    ends = ends.where(at_source | (F.col("t_type") == target_type))
    pick = lambda c, near: F.when(at_source == near, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}"))
    rows = ends.select(pick("id", True).alias("id"), pick("name", True).alias("name"), pick("name", False).alias("far"), pick("props", False).alias("props"), "amount", "status", "ord").where(node_passes(far_filter))
    found = rows.groupBy("id", "name").agg(F.count("*").alias("link_count"), F.min_by("far", "ord").alias("via"), F.sum("amount").alias("contract_amount"), F.min("ord").alias("first"))
    return found.orderBy(F.desc("link_count"), "name", "first", "id").limit(clamp(top_k)).drop("first")


def _ratio(names: pd.Series, terms: pd.Series) -> pd.Series:
    """Twice the letters of the longest common blocks over all letters; 0 where a bound shows that it is below CLOSE."""
    matcher, out, last = SequenceMatcher(), [], None
    for name, term in zip(names, terms, strict=True):
        if term != last:  # what the matcher knows of the second string is kept
            matcher.set_seq2(term)
            last = term
        matcher.set_seq1(name)
        out.append(matcher.ratio() if matcher.quick_ratio() >= CLOSE else 0.0)
    return pd.Series(out, dtype="float64")


def close_matches(n: DataFrame, terms: DataFrame, most: int = 3, least: float = CLOSE) -> DataFrame:
    """term, place, name, ratio: for each term of a small frame the names most like it, from that ratio on.

    Likeness is the Ratcliff-Obershelp ratio, names and terms as they are written. Of equal ratios the larger name comes
    first; a name that several nodes have counts as often. No common blocks can be longer than the shorter string, nor than
    the letters both have: names of unfit length never reach the ratio, those of unfit letters are not matched. The best of
    each task are cut before they are ranked.
    """
    if least < CLOSE:
        raise ValueError(f"the bounds hold from {CLOSE} on")
    wanted = terms.select("term").where("term is not null and term != ''").distinct()
    if wanted.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms at once are compared with all names")
    names = n.where("name is not null").groupBy("name").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("times"))
    a, b = F.length("name"), F.length("term")
    pairs = names.join(F.broadcast(wanted), 2 * F.least(a, b) >= least * (a + b) - 1e-9)  # at most MOST_TERMS rows
    scored = pairs.withColumn("ratio", F.pandas_udf(_ratio, "double")("name", "term")).where(F.col("ratio") >= least)
    each = scored.withColumn("_time", F.explode(F.sequence(F.lit(1), "times"))).select("term", "name", "ratio")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("ratio"), F.desc("name")))
    return each.withColumn("place", place).where(F.col("place") <= most).select("term", "place", "name", "ratio")


def names_of_type(n: DataFrame, node_type: str) -> DataFrame:
    """name of the nodes of a type, in their order (ord)."""
    return n.where(F.col("type") == node_type).select("ord", "name").orderBy("ord").select("name")


def resolve(n: DataFrame, terms: DataFrame, close: bool = False) -> DataFrame:
    """term, how (name, id, part, ambiguous or none), id, candidates for the terms of a small frame (term string).

    close: terms that nothing fits get the names most like them as candidates.

    Of nodes with one name, in lower case, the last counts. A name beats an id, an id beats parts of names; several parts
    make the term ambiguous. Names and ids are equi-joins; only terms that neither found are looked for inside names.
    """
    key = F.lower(F.regexp_replace("term", r"(?U)^\s+|\s+$", ""))
    t = terms.select("term", key.alias("key")).distinct()
    names = n.groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("id", "name"), "ord").alias("node"))
    by_name = t.join(names, "key").select("term", F.lit("name").alias("how"), F.col("node.id").alias("id"))
    rest = t.join(by_name.select("term"), "term", "left_anti")
    by_id = rest.join(n.select(F.col("id").alias("key"), "id"), "key").select("term", F.lit("id").alias("how"), "id")
    rest = rest.join(by_id.select("term"), "term", "left_anti").where("key != ''")
    inside = names.withColumnRenamed("key", "lname").join(F.broadcast(rest), F.expr("contains(lname, key)"))  # the caller's few terms
    parts = inside.groupBy("term").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node.name")).alias("candidates"), F.max("node.id").alias("id"))
    by_part = parts.select("term", F.when(F.col("n") == 1, "part").otherwise("ambiguous").alias("how"), F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") > 1, F.array_join("candidates", ";")).alias("candidates"))
    none = F.lit(None).cast("string").alias("candidates")
    found = by_name.select("*", none).unionByName(by_id.select("*", none)).unionByName(by_part)
    out = terms.select("term").distinct().join(found, "term", "left").withColumn("how", F.coalesce("how", F.lit("none")))
    if not close:
        return out
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    near = close_matches(n, out.where("how = 'none'")).groupBy("term").agg(F.array_join(listed, ";").alias("near"))
    return out.join(near, "term", "left").withColumn("candidates", F.coalesce("candidates", "near")).drop("near")
