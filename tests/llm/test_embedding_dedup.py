import math

import numpy as np
import pytest
from tidemill.llm import embedding_dedup as ed

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.93):
    """Rows are (vec_id, embedding, label)."""
    unit = []
    for _, e, label in rows:
        fine = label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        x = np.array(e, float) / max(map(abs, e)) if fine else None
        unit.append(x / np.sqrt((x * x).sum()) if fine else None)
    parent, n = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = {}
    for i, x in enumerate(unit):
        if x is not None:
            groups.setdefault((rows[i][2], len(x)), []).append(i)
    for at in groups.values():
        x = np.array([unit[i] for i in at])
        for p, q in zip(*np.nonzero(np.triu(x @ x.T >= threshold - 1e-15, 1)), strict=True):
            n[at[p]] += 1
            n[at[q]] += 1
            parent[root(at[p])] = root(at[q])
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    return sorted([(v, n[i], c := least.get(root(i)), v == c) for i, (v, *_) in enumerate(rows)], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


def near(x, cosine, rng):
    r = rng.standard_normal(len(x))
    r -= (r @ x) * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * r / np.linalg.norm(r)


def made(rng, groups=12, of=40, width=24, labels=3):
    """Groups of near vectors with chains and copies among single ones."""
    rows = []
    for _ in range(groups):
        x = rng.standard_normal(width)
        x /= np.linalg.norm(x)
        label = int(rng.integers(labels))
        for k in range(of):
            if k % 4:
                rows.append((len(rows), near(x, rng.uniform(0.955, 0.999), rng).tolist(), label))
            elif k % 8:
                x = near(x, 0.97, rng)  # the group moves on, so its ends are far apart
                rows.append((len(rows), (x * rng.uniform(0.1, 9)).tolist(), label))
            else:
                rows.append((len(rows), x.tolist(), int(rng.integers(labels))))
                rows.append((len(rows), x.tolist(), label))
    rows += [(len(rows) + k, rng.standard_normal(width).tolist(), int(rng.integers(labels))) for k in range(300)]
    return rows


@pytest.mark.parametrize("block", [5, 1024])
def test_groups_chains_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rows = made(np.random.default_rng(2))
    df = spark.createDataFrame(rows, KIND)
    assert got(ed.near_vectors(df)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [-0.0, 0.0], [nan, 1.0], [1.0, inf], [None, 1.0], [1.0], [2.0], [-1.0], [1.0, 0.0], [0.0, 1.0], [1e200, 1e-200], [1e-200, 1e-250], [5e-324, 0.0], [1.0, 0.0, 0.0], [1.0, -0.0]]
    rows = [(3 * k + i, e, label) for k, e in enumerate(odd) for i, label in ((0, 1), (1, 2), (2, None))] + [(1, [1.0, 0.0], 1), (None, [1.0, 0.0], 2), (None, [0.3, 0.9], 5), (None, None, 5)]
    rows += [(7, [3.0, 4.0], 9)] * 3
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as class", "2 as home", "3 as weight")
    assert got(ed.near_vectors(df)) == brute(rows)
    assert ed.near_vectors(spark.createDataFrame([], KIND)).count() == 0
    assert ed.near_vectors(spark.createDataFrame([(1, None, None)], KIND)).collect()[0][1:] == (0, 1, True)


def test_threshold_itself_links(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.6, 0.8], 1), (3, [0.8, 0.6], 1), (4, [3.0, 4.0], 1)]
    assert got(ed.near_vectors(spark.createDataFrame(rows, KIND), threshold=0.6, recall=1)) == brute(rows, 0.6)


def pairs_at(cosine, n, width, rng):
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(2 * k + i, v.tolist(), 0) for k in range(n) for i, v in enumerate((x[k], near(x[k], cosine, rng)))]


def test_recall_at_the_threshold(spark):
    """The hardest pairs, in random directions: at least the target recall less chance, all of them for recall=1."""
    rows = pairs_at(0.9301, 3000, 64, np.random.default_rng(4))
    df = spark.createDataFrame(rows, KIND)
    assert sum(r.n_links for r in ed.near_vectors(df).collect()) >= 0.998 * 6000
    few = rows[:1200]
    assert sum(r.n_links for r in ed.near_vectors(spark.createDataFrame(few, KIND), recall=1).collect()) == 1200


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, size):
    sf = f"/root/testdata/sf{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(ed.op13_embedding_dedup(spark, sf)) == brute(rows)


def test_staircase_is_the_traversal():
    rng = np.random.default_rng(1)
    u, v = rng.random((5, 7)), rng.random((5, 6))
    for a, b, (i, j) in zip(u, v, ed.staircase(u, v, 0.8), strict=True):
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((p, q) for p in range(7) for q in range(6) if a[p] + b[q] <= 0.8)
