"""Searches read the whole tables."""

import re

import numpy as np
from tidemill import ingest, registry, sql_functions
from tidemill import vectors as v


def small_tables(spark, folder):
    text = "the license of that version"
    docs = [(1, "zzz", "en", "s"), (2, "far away", "en", "s"), (3, "other words", "en", "s"), (4, text, "en", "s"), (5, f"{text} x", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    vectors = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [1.0, 1.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_documents_without_a_vector_are_found_by_words(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    for name in ("kw_word_similarity", "kw_trigram_similarity_all"):
        assert [r.id for r in registry.QUERIES[name](spark, sf).collect()][:2] == [4, 5]
    for name in ("hybrid_word_similarity", "hybrid_rrf_all"):
        got = {r.id: r for r in registry.QUERIES[name](spark, sf).collect()}
        assert set(got) == {1, 2, 3, 4, 5}
        assert got[4].similarity is None and got[4].rrf_score == round(1 / 61, 9) and got[3].similarity == 1.0


def test_every_question_sees_every_row(spark, monkeypatch):
    monkeypatch.setattr(v, "PART", 7)
    rng = np.random.default_rng(5)
    some = rng.normal(size=(45, 3)).astype(np.float32).tolist()
    rows = [*enumerate([*some, *some]), (90, [1.0, 2.0]), (91, None), (92, [0.0, 0.0, 0.0]), (100, [2.0, 1.0])]  # copies tie
    df = spark.createDataFrame(rows, "id long, embedding array<float>")

    def best(x):
        near = [(-np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)), k) for k, y in rows if y and len(y) == len(x) and any(x) and any(y)]
        return [k for _, k in sorted((round(s, 12), k) for s, k in near)[:6]]

    got = {}
    for r in v.nearest_of_each(df, df.where("id % 20 = 0"), 6).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got == {k: found for k, x in rows if k % 20 == 0 and x and (found := best(x))}
    assert v.nearest_of_each(df.limit(0), df, 6).count() == 0


def brute_chunks(title, text):
    size = lambda t: int(len(re.findall(r"[가-힣一-鿿぀-ヿ]", t)) + len(re.findall(r"[A-Za-z0-9]+", t)) * 1.3)
    parts = [[]]
    for line in (text or "").splitlines():
        if re.match(r"#{2,3}\s", line + "\n"):
            parts.append([])
        parts[-1].append(line)
    held, groups = [], []
    for s in filter(None, ("\n".join(p).strip() for p in parts)):
        if held and sum(map(size, held)) + size(s) > 400:
            groups.append("\n\n".join(held))
            held = []
        held.append(s)
    groups += ["\n\n".join(held)] if held else []
    out = []
    for g in groups:
        if size(g) <= 500:
            out.append(g)
            continue
        held = []
        for x in filter(None, (x.strip() for x in re.split(r"\n\s*\n", g))):
            if held and sum(map(size, held)) + size(x) > 500:
                out.append("\n\n".join(held))
                k = len(held) - 1
                while k and sum(map(size, held[k:])) < 50:
                    k -= 1
                held = held[k:]
            held.append(x)
        out.append("\n\n".join(held))
    return [x if x.startswith("# ") else f"# {title}\n\n{x}" for x in out]


def test_all_chunks_of_whole_documents(spark, sf, tmp_path):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 99, n))
    docs = [(k, "\n".join(("" if rng.random() < 0.4 else "## " if rng.random() < 0.1 else "") + words(rng.integers(1, 120)) + ("\n" if rng.random() < 0.7 else "") for _ in range(30)), "en", "s") for k in range(20)]
    docs += [(20, None, "en", "s"), (21, "", "en", "s"), (22, "# Own title\n\ntext", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), sf):
        rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
        want = {(r.doc_id, k): x for r in rows for k, x in enumerate(brute_chunks(f"Document {r.doc_id}", r.text))}
        got = registry.QUERIES["chunk_documents"](spark, folder).collect()
        assert len(got) == len(want) and {(r.doc_id, r.chunk_index): r.content for r in got} == want
    assert max(r.chunk_index for r in registry.QUERIES["chunk_prefix_all"](spark, str(tmp_path)).collect()) >= 2


def test_load_verify_counts_what_was_written(spark, sf, monkeypatch):
    paths, load = [], ingest.full_refresh
    monkeypatch.setattr(ingest, "full_refresh", lambda made, path: (paths.append(path), load(made, path))[1])
    got = registry.QUERIES["load_verify"](spark, sf).first()
    assert len(paths) == 1 and spark.read.parquet(paths[0]).count() == got.n_rows


def test_table_functions_are_the_searches(spark):
    text = "the license of that version"
    rows = [(1, "zzz", [1.0, 0.0], "a"), (2, "the license", [0.0, 1.0], "b"), (3, "", [1.0, 1.0], "a"), (4, text, None, "a"), (5, f"{text} x", [0.0, 0.0], None), (6, None, [1.0], "b"), (7, "that version", [1.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "id long, content string, embedding array<float>, kind string")
    df.createOrReplaceTempView("some_chunks")
    sql_functions.register(spark, "some_chunks")
    query = v.literal([1.0, 0.5])
    for kind, asked in ((None, "null"), ("b", "'b'")):
        got = spark.sql(f"select id, similarity from vector_search(array(1d, 0.5d), filter_kind => {asked})").collect()
        want = v.vector_search(df, query, 5, "kind", kind).select("id", "similarity").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
        got = spark.sql(f"select id, similarity, rrf_score from hybrid_search('{text}', array(1d, 0.5d), 4, {asked}, candidate_pool => 3)").collect()
        want = v.hybrid_search(df, text, query, 4, "kind", kind, pool=3).select("id", "similarity", "rrf_score").collect()
        assert {r.id: (r.similarity, round(r.rrf_score, 12)) for r in got} == {r.id: (r.similarity, round(r.rrf_score, 12)) for r in want}
    assert spark.sql("select count(*) from vector_search(array(1d, 0.5d), 99)").first()[0] == 7
    assert "TakeOrderedAndProject" in spark.sql("select * from vector_search(array(1d, 0.5d), 3)")._jdf.queryExecution().executedPlan().toString()


def test_a_refresh_replaces_the_table_and_leaves_nothing_else(spark, tmp_path):
    place = tmp_path / "chunks"
    for n in (5, 3):
        made = spark.range(n).selectExpr("id as doc_id", "0 as chunk_index", "'x' as content")
        assert ingest.full_refresh(made, str(place)).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["chunks"]
