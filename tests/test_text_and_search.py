import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemill import evaluation, ingest, sources
from tidemill import text as tx
from tidemill import vectors as v


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a b2 c", 3), ("장애 SSL 인증서 v2", 7), ("été", 1)])
def test_tokens(spark, text, n):
    assert one(spark, tx.tokens(F.lit(text))) == n


def test_sections(spark):
    md = "# T\nx\n## A\na\n### B\nb\n##\nz\n#### no"
    assert one(spark, tx.sections(F.lit(md))) == ["# T\nx", "## A\na", "### B\nb\n##\nz\n#### no"]
    assert one(spark, tx.sections(F.lit("　 \n"))) == []


def hangul(n):
    return "가" * n


def test_merge(spark):
    parts = [hangul(n) for n in (150, 200, 100, 390, 20)]
    got = one(spark, tx.merged(F.array(*map(F.lit, parts))))
    assert got == [parts[0] + "\n\n" + parts[1], parts[2], parts[3], parts[4]]
    assert one(spark, tx.merged(F.array(F.lit(hangul(900))))) == [hangul(900)]


def test_oversize(spark):
    a, b, c, d = (hangul(n) for n in (300, 30, 40, 200))
    assert one(spark, tx.split_oversize(F.lit("\n\n".join((a, b, c, d))))) == ["\n\n".join((a, b, c)), "\n\n".join((b, c, d))]
    x, y = hangul(490), hangul(480)
    assert one(spark, tx.split_oversize(F.lit(x + "\n \n" + y))) == [x, x + "\n\n" + y]
    assert one(spark, tx.split_oversize(F.lit("short"))) == ["short"]


def test_document_chunks(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps([{"id": "DOC-001", "title": "One", "type": "proposal", "filename": "a.md"}, {"id": "DOC-002", "title": "Two", "type": "meeting_note", "filename": "b.md"}]))
    (tmp_path / "a.md").write_text("# One\n\nintro\n## Part\n" + "\n\n".join(hangul(240) for _ in range(4)))
    (tmp_path / "b.md").write_text("## only\ntext")
    docs = sources.read_documents(spark, str(tmp_path / "index.json"), str(tmp_path))
    made = tx.chunks(docs)
    rows = made.orderBy("ord", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index) for r in rows][0] == ("DOC-001", 0) and rows[-1].content == "# Two\n\n## only\ntext"
    assert rows[0].metadata.doc_type == "제안서" and rows[-1].metadata.source_path == "documents/b.md"
    vectors = ingest.embed(made, ingest.hashed_frequencies(8), 8)
    for _ in range(2):
        loaded = ingest.full_refresh(vectors, str(tmp_path / "table"))
        assert loaded.count() == len(rows) and {len(r.embedding) for r in loaded.collect()} == {8}
    with pytest.raises(Exception, match="another width"):
        ingest.embed(made, ingest.hashed_frequencies(4), 8).collect()
    bad = docs.withColumn("type", F.lit("poem"))
    with pytest.raises(Exception, match="unknown document type"):
        tx.chunks(bad).collect()


def test_incremental_load(spark, tmp_path):
    kinds = "doc_id string, content string"
    make = lambda df: df.select("doc_id", F.posexplode(tx.merged(F.split("content", "\n"), glue="\n")).alias("chunk_index", "content"))
    for k in range(2):
        spark.createDataFrame([(f"d{k}", "a\nb"), (f"e{k}", "c")], kinds).write.mode("append").parquet(str(tmp_path / "in"))
        query = ingest.incremental(spark, str(tmp_path / "in"), kinds, make, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * (k + 1)


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"q": "a", "tool": "x", "hint": "h"}, {"q": "b", "tool": "y", "hint": "h"}]))
    assert [r.q for r in sources.read_questions(spark, str(tmp_path / "q.json"), "y").collect()] == ["b"]


def brute_word_similarity(query, text):
    wanted, grams = set(v._gram_list(query)), v._gram_list(text)
    best = 0.0
    for a in range(len(grams)):
        for b in range(a + 1, len(grams) + 1):
            part = set(grams[a:b])
            best = max(best, len(part & wanted) / len(part | wanted))
    return best


words = st.lists(st.sampled_from(["word", "two", "words", "wor", "a", "ab", "three", "the"]), max_size=7).map(" ".join)


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_word_similarity_is_the_best_stretch(query, text):
    assert v.word_similarity_of(query, text) == pytest.approx(brute_word_similarity(query, text))


def test_rrf(spark):
    chunks = spark.createDataFrame([(1, "zzz", [1.0, 0.0]), (2, "needle word", [0.9, 0.1]), (3, "needle", [0.0, 1.0])], "id long, content string, embedding array<double>")
    got = v.hybrid_search(chunks, "needle word", v.literal([1, 0]), 3, pool=2).collect()
    assert [r.id for r in got] == [2, 1, 3]
    assert got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61) and got[1].rrf_score == pytest.approx(1 / 61) and got[2].rrf_score == pytest.approx(1 / 62)
    assert got[1].similarity == pytest.approx(1.0)
    with pytest.raises(ValueError):
        v.check(11)
    with pytest.raises(ValueError):
        v.check(5, "poem", ("report",))


def test_cosine_of_odd_vectors(spark):
    assert one(spark, v.cosine(v.literal([0, 0]), v.literal([1, 2]))) is None
    assert one(spark, v.cosine(v.literal([1]), v.literal([1, 2]))) is None


def test_envelope(spark):
    df = spark.sql("select cast(10.00 as decimal(6,2)) a, cast(10.50 as decimal(6,2)) b, date'2025-07-01' c, true d, null e from range(3)")
    got = evaluation.envelope(df, 2)
    assert got == {"columns": list("abcde"), "rows": [[10, 10.5, "2025-07-01", True, None]] * 2, "row_count": 2, "truncated": True}
    assert not evaluation.envelope(df, 3)["truncated"]


def test_top_k_plan_is_a_top_k(spark):
    rng = random.Random(1)
    chunks = spark.createDataFrame([(k, [rng.random(), rng.random()]) for k in range(50)], "id long, embedding array<double>")
    plan = v.vector_search(chunks, v.literal([1, 0]))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
