"""The vector index against exact searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemill import vector_index as vi
from tidemill import vectors as v
from tidemill.plans.search_queries import asked, embedded

KIND = "id long, embedding array<float>, kind string"


def clustered(spark, n=4000, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width))
    x = (centers[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * 0.6).astype(np.float32)
    return spark.createDataFrame([(k, r, "ab"[k % 2]) for k, r in enumerate(x.tolist())], KIND)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_whole_tables(spark, tmp_path, sf):
    e = embedded(spark, f"/root/testdata/sf{sf}")
    index = vi.build(e, str(tmp_path / "i"))
    found = vi.recall(vi.search_each(index, asked(e), 10), v.nearest_of_each(e, asked(e), 10)).first()
    assert found.recall >= 0.9 and found.wanted == found.questions * 10
    assert index.probes < len(index.centroids)


def test_fewer_cells_are_probed_where_rows_cluster(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(v, "PART", 100)
    rows = clustered(spark).cache()
    index = vi.build(rows, str(tmp_path / "i"))
    assert index.probes <= len(index.centroids) // 3
    assert vi.recall(vi.search_each(index, asked(rows), 10), v.nearest_of_each(rows, asked(rows), 10)).first().recall >= 0.9
    again = vi.open_index(spark, str(tmp_path / "i"))
    assert again.probes == index.probes and np.allclose(again.centroids, index.centroids)
    one = rows.where("id = 7").first().embedding
    got, exact = ({r.id for r in df.collect()} for df in (vi.search(again, spark, one, 10), v.nearest(rows, v.literal(one), 10)))
    assert len(got & exact) >= 8
    plan = vi.search(again, spark, one, 10)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell" in plan


def test_filter_after_the_pool(spark, tmp_path):
    rows = clustered(spark, 600)
    index = vi.build(rows, str(tmp_path / "i"))
    every = len(index.centroids)
    one = rows.where("id = 8").first().embedding
    pool = v.nearest(rows, v.literal(one), 40).collect()
    want = [r.id for r in pool if r.kind == "a"][:30]
    assert len(want) < 30
    assert [r.id for r in vi.search(index, spark, one, 30, F.col("kind") == "a", every).collect()] == want
    each = vi.search_each(index, rows.where("id = 8"), 30, F.col("kind") == "a", every).orderBy("rank").collect()
    assert [r.id for r in each] == want and [r["rank"] for r in each] == list(range(1, len(want) + 1))


def test_appended_rows_are_found(spark, tmp_path):
    rows = clustered(spark, 500)
    index = vi.build(rows, str(tmp_path / "i"))
    far = [100.0] + [0.0] * 15
    vi.append(index, spark.createDataFrame([(9001, far, "c"), (9002, None, "c"), (9003, [0.0] * 16, "c")], KIND))
    assert vi.search(index, spark, far, 1).first().id == 9001
    assert index.lists(spark).count() == 501
    with pytest.raises(ValueError, match="one width"):
        vi.append(index, spark.createDataFrame([(1, [1.0], "c")], KIND))
    with pytest.raises(ValueError, match="width 16"):
        vi.search(index, spark, [1.0], 1)


def test_empty_and_single(spark, tmp_path):
    none = vi.build(spark.createDataFrame([], KIND), str(tmp_path / "none"))
    assert vi.search_each(none, spark.createDataFrame([(1, [1.0], "a")], KIND), 3).count() == 0
    one = vi.build(spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, None, "a")], KIND), str(tmp_path / "one"))
    assert [r.id for r in vi.search(one, spark, [1.0, 2.0], 3).collect()] == [1, 1]
