import hashlib
import random
from collections import Counter

import pytest
from tidemill.llm import substring_dedup as substring_dedup_module
from tidemill.llm.substring_dedup import SuffixAutomaton, op1_substring_dedup, substring_dedup

from .test_minhash_dedup import thue_morse


def brute(rows, window):
    tokens = [(i, (t or "").encode().split()) for i, t in rows]
    runs = Counter(tuple(w[k : k + window]) for _, w in tokens for k in range(len(w) - window + 1))
    out = []
    for i, w in tokens:
        gone = set()
        for k in range(len(w) - window + 1):
            if runs[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, size):
    sf = f"/root/testdata/sf{size}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = got(op1_substring_dedup(spark, sf))
    assert found == brute(rows, 35)
    assert sum(r[2] for r in found) > 0


def test_edges(spark):
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    a = " ".join(f"p{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b a b a b a b a b"), (5, long), (5, long + " x"), (None, a), (7, "q " + a), (8, "z " * 200), (9, "one"), (9, "one"), (10, "\x1c\x85  u  v")]
    for window in (3, 5, 35):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 as anchor", "2 as piece", "'x' as spans")
        assert got(substring_dedup(df, window)) == brute(rows, window)
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shard", [512, 8])
def test_near_copies(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup_module, "SHARD", shard)

    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(300)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    assert got(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 35)) == brute(rows, 35)


def test_automaton_counts():
    automaton = SuffixAutomaton([[1, 2, 3, 1, 2], [2, 3, 1]], [1, 1])
    assert automaton.repeated([2, 3, 1, 9], 3) == 1
    assert automaton.repeated([3, 1, 2], 3) == 0


def test_long_words_and_long_texts(spark, monkeypatch):
    a, b = thue_morse()
    w, v = " ".join(f"w{k}" for k in range(17)), " ".join(f"v{k}" for k in range(17))
    rows = [(1, f"{w} {a} {v}"), (2, f"{w} {b} {v}"), (3, " ".join(a)), (4, " ".join(b))]
    assert got(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 35)
    monkeypatch.setattr(substring_dedup_module, "PART", 100)  # a text of more words than one part holds
    rng = random.Random(2)
    words = [f"w{rng.randrange(300)}" for _ in range(1500)]
    rows = [(1, " ".join(words)), (2, " ".join(words[300:900])), (3, " ".join(words[1000:] + words[:90]))]
    assert got(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 35)
