"""Close matches against the standard library's."""

import difflib

import pytest
from tidemill import graph as g
from tidemill import registry
from tidemill import sources as s
from tidemill.plans.graph_queries import UNKNOWN

KIND = "ord long, id string, type string, name string, props map<string,string>"


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.term, r.place)):
        out.setdefault(r.term, []).append(r["name"])
    return out


def test_all_node_names(spark):
    sf = "/root/testdata/sf0.01"
    names = [r["name"] for r in s.nodes(spark, sf).select("name").collect()]
    got = listed(registry.QUERIES["g_close_matches"](spark, sf))
    want = {t: found for t in UNKNOWN if (found := difflib.get_close_matches(t, names, n=3, cutoff=0.6))}
    assert got == want and len(got) >= 3


def test_odd_names(spark):
    names = ["abcd", "abcd", "abcd", "abcd", "abce", "ABCD", "", None, "한국어 이름", "한국 이름", "a", "😀😀b", "x" * 300, "x" * 250 + "y" * 50]
    terms = ["abcf", "bcd", "한국어이름", "a", "b", "😀b", "x" * 290, "ab cd", None, "", "zzzz"]
    n = spark.createDataFrame([(i, str(i), "t", x, {}) for i, x in enumerate(names)], KIND)
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    known = [x for x in names if x is not None]
    for most, least in ((3, 0.6), (5, 0.75)):
        want = {x: f for x in terms if x and (f := difflib.get_close_matches(x, known, n=most, cutoff=least))}
        assert listed(g.close_matches(n, t, most, least)) == want
    with pytest.raises(ValueError, match="from 0.6 on"):
        g.close_matches(n, t, 3, 0.2)


def test_resolve_names_candidates_of_unknown_terms(spark, sf):
    n = s.nodes(spark, sf)
    terms = spark.createDataFrame([(x,) for x in ("NATION_1", "NATOIN_1", "red", "qqqq")], "term string")
    names = [r["name"] for r in n.collect()]
    got = {r.term: (r.how, r.candidates) for r in g.resolve(n, terms, close=True).collect()}
    assert got["NATION_1"] == ("name", None) and got["red"][0] == "ambiguous" and got["qqqq"] == ("none", None)
    assert got["NATOIN_1"] == ("none", ";".join(difflib.get_close_matches("NATOIN_1", names, n=3, cutoff=0.6)))


def test_terms_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(g, "MOST_TERMS", 2)
    n = spark.createDataFrame([(1, "1", "t", "abc", {})], KIND)
    with pytest.raises(ValueError, match="at most 2"):
        g.close_matches(n, spark.createDataFrame([("a",), ("b",), ("c",)], "term string"))
