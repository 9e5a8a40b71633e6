"""The trigram index against full scans."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemill import registry
from tidemill import trigram_index as ti
from tidemill import vectors as v

KIND = "id long, content string"


def some(spark, n=400):
    rng = random.Random(8)
    words = ["license", "version", "the", "that", "of", "ring", "résumé", "日本語", "x1", "under_score"]
    rows = [(k, " ".join(rng.choice(words)[: rng.randrange(2, 9)] for _ in range(rng.randrange(1, 30)))) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "-- !"), (n + 3, "The LICENSE, of that version")], KIND)


@pytest.mark.parametrize("least", [0.0, 0.02, 0.2, 0.45, 0.9])
def test_search_equals_the_full_scan(spark, tmp_path, least):
    df = some(spark)
    index = ti.build(df, str(tmp_path / "i"))
    for text in ("license of version", "日本", "résumé x1", "zzz"):
        score = lambda c, t=text: v.trigram_similarity(v.trigrams(c), v.trigrams(F.lit(t)))
        want = [tuple(r) for r in v.keyword_search(df, score, 1000, least).select("id", "keyword").collect()]
        assert [tuple(r) for r in ti.search(index, spark, text, 1000, least).collect()] == want
    assert ti.search(index, spark, " -", 5).count() == 0


def test_word_search_equals_the_full_scan(spark, tmp_path):
    df = some(spark)
    index = ti.build(df, str(tmp_path / "i"))
    rows = [(r.id, r.content) for r in df.where("content is not null").collect()]
    for text, k in (("license version", 7), ("résumé of 日本語", 300), ("nothing", 5)):
        want = sorted(((-v.word_similarity_of(text, t), i) for i, t in rows))[:k]
        got = [(-r.keyword, r.id) for r in ti.word_search(index, df, text, k).collect()]
        assert got == [(s, i) for s, i in want if -s > 0.1]
    assert ti.word_search(index, df, "", 5).count() == 0


def test_lists_are_pruned_and_texts_not_read(spark, tmp_path):
    df = some(spark)
    df.write.parquet(str(tmp_path / "texts"))
    index = ti.build(spark.read.parquet(str(tmp_path / "texts")), str(tmp_path / "i"))
    plan = ti.search(index, spark, "license", 5, 0.3)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and "In(gram" in plan and "/texts" not in plan


def test_words_axis_by_index_equals_the_scan(spark):
    for a, b in (("kw_word_index", "kw_word_similarity"), ("hybrid_word_index", "hybrid_word_similarity")):
        sf = "/root/testdata/sf0.01"
        got, want = ([tuple(r) for r in registry.QUERIES[q](spark, sf).collect()] for q in (a, b))
        assert got == want and got


def test_empty(spark, tmp_path):
    index = ti.build(spark.createDataFrame([(1, None)], KIND), str(tmp_path / "i"))
    assert ti.search(index, spark, "license", 5).count() == 0


def test_one_row_for_each_block_and_trigram(spark, tmp_path):
    """Lists are shuffled and kept in pieces, not in a row for each text; every text is in one block, with its set's size."""
    df = some(spark)
    index = ti.build(df.coalesce(2), str(tmp_path / "i"))
    rows = index.table(spark).collect()
    want = {r.id: set(r.g) for r in df.where("content is not null").select("id", v.trigrams(F.col("content")).alias("g")).collect()}
    blocks = {r.block: list(zip(r.ids, r.ns, strict=True)) for r in rows if r.gram is None}
    assert sorted(x for b in blocks.values() for x in b) == sorted((i, len(g)) for i, g in want.items())
    lists = [r for r in rows if r.gram is not None]
    assert len(lists) == len({(r.gram, r.block) for r in lists}) and len(blocks) <= 2
    assert sorted((blocks[r.block][p][0], r.gram) for r in lists for p in r.places) == sorted((i, g) for i, gs in want.items() for g in gs)


@pytest.mark.parametrize("block", [0, 300, 1 << 20])
@pytest.mark.parametrize("letters", ["abcdé\U0001d49c", "".join(map(chr, range(0x4E00, 0x5200)))])
def test_blocks_equal_a_plain_loop(spark, block, letters):
    rng = random.Random(3)
    texts = [[" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(9)))] for _ in range(120)]
    batches = [pa.RecordBatch.from_arrays([pa.array([5] * 40, pa.int32()), pa.array(range(k, k + 40)), pa.array([t[0] for t in texts[k : k + 40]])], ["task", "id", "lower"]) for k in (0, 40, 80)]
    found, blocks = [], {}
    for batch in ti._lists(ti._letters(spark), block)(iter(batches)):
        for r in batch.to_pylist():
            if r["gram"] is None:
                blocks[r["block"]] = r["ids"]
            else:
                found += [(blocks[r["block"]][p], r["gram"]) for p in r["places"]]
    assert sorted(found) == sorted((i, g) for i, t in enumerate(texts) for g in set(v._gram_list(t[0])))
    assert sorted(i for b in blocks.values() for i in b) == list(range(120))


def test_signs_beyond_the_basic_plane_start_one_trigram(spark, tmp_path):
    text = "\U0001d49cb x"
    assert sorted(ti.grams_of(spark, text)) == sorted(set(v._gram_list(text)))
    index = ti.build(spark.createDataFrame([(1, text), (2, "x")], KIND), str(tmp_path / "i"))
    assert [tuple(r) for r in ti.search(index, spark, text, 5).collect()] == [(1, 1.0), (2, 0.4)]


def test_one_large_partition_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ti, "SPREAD", 1000)
    df = some(spark)
    index = ti.build(df.coalesce(1), str(tmp_path / "i"))
    blocks = index.table(spark).where("gram is null").collect()
    assert len({r.block >> 32 for r in blocks}) >= 4 and sorted(i for r in blocks for i in r.ids) == sorted(r.id for r in df.where("content is not null").collect())


def test_word_search_does_not_shuffle_all_texts(spark, tmp_path):
    df = some(spark)
    kept = ti._only(df, df.where("id < 3"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [place" in plan and sorted(r.id for r in kept.collect()) == [0, 1, 2]


def test_a_floor_leaves_scores_from_it_on_exact():
    rng = random.Random(4)
    query = "the license of that version"
    for _ in range(300):
        text = " ".join(rng.choice(["the", "license", "lice", "of", "that", "version", "x", "versions", "other"]) for _ in range(rng.randrange(1, 60)))
        wanted, grams = set(v._gram_list(query)), v._gram_list(text)
        exact = 0.0
        for i in range(len(grams)):
            distinct = set()
            for g in grams[i : i + 200]:
                distinct.add(g)
                exact = max(exact, len(distinct & wanted) / len(distinct | wanted))
        assert v.word_similarity_of(query, text) >= exact - 1e-12 and np.isclose(v.word_similarity_of(query, text), exact)
        for floor in (0.3, exact, 0.9):
            got = v.word_similarity_of(query, text, floor)
            assert got == v.word_similarity_of(query, text) if exact >= floor else got < floor
