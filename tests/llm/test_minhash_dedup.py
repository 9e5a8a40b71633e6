import random

import numpy as np
import pytest
from tidemill.llm import minhash_dedup
from tidemill.llm.minhash_dedup import near_duplicates, op4_minhash_dedup


def brute(rows, size=3, least_part=(85, 100)):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posted = {}
    for i, s in enumerate(sets):
        for x in s:
            posted.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in posted[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if least_part[1] * c >= least_part[0] * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(s), c := (least.get(root(i), d) if s else d), d == c) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, size):
    sf = f"/root/testdata/sf{size}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = got(op4_minhash_dedup(spark, sf))
    assert found == brute(rows)
    assert any(not r[3] for r in found)


def test_edges_and_chains(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c"), (7, "A b C"), (None, "x y z w"), (9, "x y z w"), (8, None)]
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(120)] = f"e{rng.randrange(10_000)}"
            rows.append((rng.randrange(10**6), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as band", "3 as n")
    assert got(near_duplicates(df)) == brute(rows)
    assert got(near_duplicates(df, 5, (4, 5))) == brute(rows, 5, (4, 5))
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def boilerplate(n, seed):
    """Texts of which two share 100 words in a row and differ in 15: Jaccard 0.77 at most, many common buckets."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(100)]
    return [(k, " ".join([*base, *(f"t{rng.randrange(400)}" for _ in range(15))])) for k in range(n)]


def test_boilerplate_sends_few_texts(spark, monkeypatch):
    rows = boilerplate(3000, 5)
    rows += [(5000 + k, t.rsplit(" ", 3)[0] + f" e{k} f{k} g{k}") for k, (_, t) in enumerate(rows[:40])]
    sent = []
    across = minhash_dedup.across

    def counted(*args):
        out = across(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "across", counted)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: k - 5000 if k >= 5000 else k for k, _ in rows}
    assert 2 * sum(sent) < 10_000


def test_heavy_shingles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "HEAVY", 40)
    rng = random.Random(8)
    rows = [(k, t) for k, t in boilerplate(80, 9)]
    for k in range(160):  # chains: neighbours link, ends do not
        w = rows[rng.randrange(len(rows))][1].split()
        w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        rows.append((1000 + k, " ".join(w)))
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_many_classes_near_each_other_make_few_pairs(spark, monkeypatch):
    """None is near the smallest of its buckets, and most pairs of the group lie just below the threshold."""
    rng, base, rows = random.Random(4), [f"b{k}" for k in range(150)], []
    for k in range(400):  # two of 10 words at the end have 0.77, one of 10 and one of 4 at least 0.8
        w = [*base, *(f"t{k}x{e}" for e in range(10 if k < 376 else 4))]
        w[rng.randrange(5, 145)] = f"e{k}"
        rows.append((k, " ".join(w)))
    sent, across = [], minhash_dedup.across

    def counted(*args):
        out = across(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "across", counted)
    monkeypatch.setattr(minhash_dedup, "WAYS", 8, raising=False)
    monkeypatch.setattr(minhash_dedup, "HUBS", 8, raising=False)
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, (4, 5))) == brute(rows, 5, (4, 5))
    assert sum(sent) < 10 * len(rows)  # 11,535 when all of them met


def test_group_below_the_threshold_makes_few_pairs_and_turns(spark, monkeypatch):
    """Texts of two edits each differ in 40 shingles, where 32 may; a few of one edit link with most of them."""
    rng, base, rows = random.Random(6), [f"b{k}" for k in range(150)], []
    for k in range(400):
        w = list(base)
        for at in rng.sample(range(5, 145), 2 if k < 300 or k % 20 else 1):
            w[at] = f"e{k}x{at}"
        rows.append((k, " ".join(w if k >= 200 else ["q", *w, "q"])))
    sent, tables, across, cut = [], [], minhash_dedup.across, minhash_dedup.cut

    def counted(*args):
        out = across(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "across", counted)
    monkeypatch.setattr(minhash_dedup, "cut", lambda df, name="cut": (tables.append(name), cut(df, name))[1])
    for name in ("WAYS", "HUBS"):
        monkeypatch.setattr(minhash_dedup, name, 4)
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, (4, 5))) == brute(rows, 5, (4, 5))
    assert sum(sent) < 5 * len(rows) and tables.count("hubs") <= 2


def thue_morse():
    """Two words that every polynomial hash modulo 2^64 with an odd base takes for one."""
    t = "0"
    while len(t) < 1024:
        t += t.translate(str.maketrans("01", "10"))
    return t.translate(str.maketrans("01", "ab")), t.translate(str.maketrans("01", "ba"))


def test_long_words_differ(spark):
    a, b = thue_morse()
    rows = [(1, f"{a} x y z"), (2, f"{b} x y z"), (3, " ".join(["u", "v"][c == "b"] for c in a)), (4, " ".join(["u", "v"][c == "b"] for c in b)), (5, f"{a} x Y z"), (6, a), (7, b)]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_checks_compare_words():
    a, b = minhash_dedup.exact_shingles([b"a b c a b c d", b"b c d e a b c"], 3)
    assert len(a) == 4 and len(b) == 5 and len(np.intersect1d(a, b)) == 2
