"""How rows and questions of the vector searches are dealt over parts."""

import numpy as np
import pyarrow as pa
import pytest
from tidemill import vector_index as vi
from tidemill import vectors as v


def clustered(n=1500, width=8, seed=9):
    """Clusters of unlike sizes, a hot vector, rows that are multiples of others, ids that come twice."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(9, width))[rng.choice(9, n, p=[0.4, *[0.075] * 8])] + rng.normal(size=(n, width)) * 0.5
    x[100:400] = x[7]
    x[500:520] = 2 * x[480:500]
    ids = np.arange(n)
    ids[1400:1420] = ids[20:40]
    return ids, x.astype(np.float32)


def frame(spark, ids, x, kind="float"):
    odd = [(9001, None), (9002, [0.0] * x.shape[1])]
    return spark.createDataFrame([*zip(ids.tolist(), x.tolist(), strict=True), *odd], f"id long, embedding array<{kind}>")


def plain(index, ids, x, asked, probes, k):
    """Each question's best k of the rows whose nearest centroid is among the question's nearest ones."""
    x = x.astype(np.float64)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = unit @ index.centroids.T
    own, s = near.argmax(axis=1), unit @ unit.T
    out = []
    for q in asked:
        at = np.flatnonzero(np.isin(own, np.argsort(-near[q])[:probes]))
        best = sorted(at.tolist(), key=lambda j: (-round(s[q, j], 9), ids[j]))[:k]
        out += [(int(ids[q]), round(float(s[q, j]), 9)) for j in best]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_probed_cells_and_no_others_are_searched(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(v, "PART", 100)
    ids, x = clustered()
    rows = frame(spark, ids, x, kind)
    index = vi.build(rows, str(tmp_path / "i"), cells=40)
    sizes = [r["count"] for r in index.lists(spark).groupBy("cell").count().collect()]
    assert max(sizes) > 300 and sum(n < 50 for n in sizes) > 10
    asked = [*range(0, 1400, 50), 485, 505]
    questions = frame(spark, ids[asked], x[asked], kind)
    found = vi.search_each(index, questions, 12, probes=7).collect()
    assert sorted((r.q, round(r.similarity, 9)) for r in found) == plain(index, ids, x, asked, 7, 12)
    by_rank = [r for r in sorted(found, key=lambda r: (r.q, r["rank"])) if r.q == 505]
    assert [(-r.similarity, r.id) for r in by_rank] == sorted((-r.similarity, r.id) for r in by_rank)


def test_a_question_is_sent_once_to_a_part(spark, tmp_path, monkeypatch):
    ids, x = clustered()
    rows = frame(spark, ids, x)
    index = vi.build(rows, str(tmp_path / "i"), cells=40)

    def sent(k):
        def run(batches):
            for b in batches:
                asked = b.filter(pa.array(b["asked"].to_numpy() == 1))
                yield pa.RecordBatch.from_arrays([asked["part"], asked["id"], pa.array(np.zeros(asked.num_rows))], ["q", "id", "similarity"])

        return run

    monkeypatch.setattr(v, "PART", 400)
    monkeypatch.setattr(v, "_nearest_in_parts", sent)
    asked = list(range(0, 1400, 50))
    copies = vi.search_each(index, frame(spark, ids[asked], x[asked]), 10**6, probes=30).groupBy("q").count().collect()
    assert len(copies) <= 2 * -(-len(ids) // 400) and sum(r["count"] for r in copies) <= len(copies) * len(asked)


def test_parts_are_full_and_no_fuller(spark, monkeypatch):
    monkeypatch.setattr(v, "PART", 10)
    lists = spark.createDataFrame([(c,) for c, n in {0: 4, 1: 6, 3: 1, 4: 25, 5: 9, 6: 2}.items() for _ in range(n)], "cell int")
    first, blocks = vi._parts(lists, 8)
    assert blocks.tolist() == [1, 1, 0, 1, 3, 1, 1, 0]
    assert first[[0, 1, 3, 4, 5, 6]].tolist() == [0, 0, 3, 4, 5, 6]


def test_vectors_are_shuffled_as_they_are(spark):
    ids, x = (some[:60] for some in clustered())
    for kind in ("float", "double"):
        rows = frame(spark, ids, x, kind)
        plan = v.nearest_of_each(rows, rows, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert "array<double>" not in plan
    mixed = v.nearest_of_each(frame(spark, ids, x), frame(spark, ids, x, "double"), 3)
    same = v.nearest_of_each(frame(spark, ids, x), frame(spark, ids, x), 3)
    assert mixed.exceptAll(same).isEmpty() and same.exceptAll(mixed).isEmpty()
