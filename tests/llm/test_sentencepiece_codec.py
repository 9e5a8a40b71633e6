import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tidemill.llm import sentencepiece_codec as s
from tidemill.llm.sentencepiece_codec import encoded_and_checked, op8_sentencepiece

V = s.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=s.MODEL)


def ids(text):
    return s.encode_texts(V, [s.SPACE + s.escape(text)])[0].tolist() if text else []


TEXTS = ["The quick brown fox", "a", " ", "  two  blanks ", "é ü 😀 full ｆｕｌｌ 日本語テキスト", "line\n\ttabs\r\n end", "x" * 60, "0123456789 " * 5, "Anblewh sttible athawh thonre", "x" * 3000, "日本語の文" * 200, *[" " * n + "the" + " " * (n // 2) for n in range(40)]]


def test_ids_match_the_library(library, spark):
    texts = TEXTS + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for t, want in zip(texts, library.encode(texts, num_threads=1), strict=True):
        got = ids(t)
        assert got == want, t[:80]
        assert s.decode_ids(V, got) == t


def test_neighbours_match_the_merge_loop():
    rng = random.Random(5)
    rank = {p: -x for p, x in ((q.piece, q.score) for q in model().pieces if q.type == 1)}
    id_of = {p.piece: k for k, p in enumerate(model().pieces) if p.type == 1}
    names = list(id_of)
    some = [(rng.choice(names), rng.choice(names)) for _ in range(3000)]
    for p in rng.sample(names, 1500):  # and pairs that often are no neighbours
        k = rng.randrange(len(p))
        if p[:k] in id_of and p[k:] in id_of:
            some.append((p[:k], p[k:]))
        some += [(p[:k], q) for q in ("e", "s", "ing", "▁", "▁▁") if p[:k] in id_of]
    got = s.neighbours(V, np.array([id_of[a] for a, _ in some]), np.array([id_of[b] for _, b in some]))
    assert got.tolist() == [s.merge(a + b, rank)[0] == [a, b] for a, b in some]
    assert 0 < got.sum() < len(got)


def model():
    out = sentencepiece_model_pb2.ModelProto()
    with open(s.MODEL, "rb") as f:
        out.ParseFromString(f.read())
    return out


def test_chunks_match_the_whole():
    rng, pairs = random.Random(1), s.Pairs(V)
    texts = ["".join(rng.choice("abcdeé thes ing\n日") for _ in range(400)) for _ in range(15)] + ["thesestationing" * 30, " " * 100, "日本" * 60, "x", "in" * 200 + " " * 40 + "\n" * 40]
    for t in texts:
        whole = s.SPACE + s.escape(t)
        for size in (16, 17, 40, 101):
            chunks = []
            for k in range(0, len(whole), size):
                before = min(k, V.longest)
                hi = min(size, len(whole) - k)
                chunks.append(s.Chunk(pairs, whole[k - before : k + hi + V.longest], before, before + hi, k == 0, k + hi == len(whole)))
            matrices = [c.transfer() for c in chunks]
            assert s.product(matrices).tolist() == [[0]]
            half = len(matrices) // 2 or 1
            found = s.states(matrices)
            if len(matrices) > half:  # the same by way of two groups
                (a, b), (c, d) = s.states([s.product(matrices[:half]), s.product(matrices[half:])])
                assert found == s.states(matrices[:half], a, b) + s.states(matrices[half:], c, d)
            assert [x for c, (a, b) in zip(chunks, found, strict=True) for x in c.trace(a, b).tolist()] == ids(t)


def test_product_is_associative():
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(-50, 0, (4, 4)).astype(float) for _ in range(3))
    assert (s.combine(s.combine(a, b), c) == s.combine(a, s.combine(b, c))).all()


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.exact and r.n_chars == len(texts[r.doc_id]) and r.n_ids == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 50)
    rng = random.Random(9)
    monkeypatch.setattr(s, "FAN", 4)
    rows = [(1, None), (2, ""), (3, " "), (4, "a▁b ▁"), (None, "x y"), (5, "same"), (5, "same"), (6, "\n" * 120), (7, "thing" * 70), (8, "".join(rng.choice("ab é日\n") for _ in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded", "3 as chunk", "4 as row_id", "5 as _row")
    assert all(r.exact for r in encoded_and_checked(df).collect())
    got = {(r.doc_id, r.text): r.ids for r in s.decode(s.encode(df)).where("decoded <=> coalesce(text, '')").collect()}
    assert got == {(i, t): ids(t) for i, t in rows}
    assert s.encode(df).count() == len(rows)
    assert encoded_and_checked(df.limit(0)).count() == 0


def test_long_texts(spark, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(("the ", "a", "日本", "ing", " \n")) for _ in range(150_000)), "thesestationing" * 20_000]
    got = {r.doc_id: r.ids for r in encoded_and_checked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("exact").collect()}
    assert [got[0], got[1]] == library.encode(texts, num_threads=1)
