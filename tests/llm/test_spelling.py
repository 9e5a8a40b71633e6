import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tidemill.llm import spelling
from tidemill.llm.spelling import edited, neighbourhoods, op11_spelling_groups, spelling_groups, word_hashes

LOWER = {chr(65 + k): chr(97 + k) for k in range(26)}


def brute(rows, length=6, count=5, factor=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(LOWER.get(c, c) for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    holes: dict = {}  # words are near if they agree but for one place, or for one letter too many
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), ws in holes.items():
        for w in ws | ({a + b} & set(words)):
            near[w] |= (ws | ({a + b} & set(words))) - {w}
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * c else None
    out = []
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, c, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, size):
    sf = f"/root/testdata/sf{size}"
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    found = got(op11_spelling_groups(spark, sf))
    assert found == want
    assert any(r[2] > 1 for r in found) and any(r[3] for r in found)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 50)
    monkeypatch.setattr(spelling, "HELD", 7)
    rng = random.Random(5)
    chain = "planet " * 700 + "planets " * 130 + "planetsx " * 25 + "planetsxy " * 5 + "plannet " * 130
    rows = [(1, chain), (1, chain), (None, "Abcdef " * 9), (None, None), (3, ""), (4, "aaaaaa aaaaaaa aaaaaaaa " * 6 + "baaaaa " * 40), (5, "ÉTÉÉTÉ étéété ×÷×÷×÷ " * 7)]
    rows += [(6, ("q" * 5000 + " ") * 6 + ("q" * 4999 + "r ") * 40)]
    for k in range(300):
        rows.append((k * 7, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))) for _ in range(60)) + ";unlettered1" * (k % 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as form")
    want = brute(rows)
    assert got(spelling_groups(df)) == want
    assert next(r for r in want if r[0] == "planetsxy")[-1] == "planet"
    assert got(spelling_groups(df, 5, 9, 2)) == brute(rows, 5, 9, 2)
    assert spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling_groups(spark.createDataFrame([(1, "few words")], "doc_id long, text string")).count() == 0


def test_full_sieve_changes_nothing(spark, monkeypatch):
    """Where every candidate passes the filter, the join alone decides."""
    monkeypatch.setattr(spelling, "passes", lambda words, keys: np.ones(len(keys), bool))
    rows = [(1, "planet " * 50 + "planer " * 6 + "plane " * 7 + "planett " * 5)]
    assert got(spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("words", [["a", "é"], ["aab", "zzé", "bbb"], ["abcabc"]])
@pytest.mark.parametrize("block", [1, 1 << 18])
def test_neighbourhoods_are_whole_and_distinct(words, block):
    alphabet = np.array(sorted(map(ord, "abzé")), np.uint64)
    made = [[] for _ in words]
    for kind, hashes, of, places, letters in neighbourhoods(words, alphabet, block):
        for h, i, p, c in zip(hashes.tolist(), of.tolist(), places.tolist(), letters.tolist(), strict=True):
            made[i].append((edited(words[i], kind, p, c), h))
    for word, pairs in zip(words, made, strict=True):
        strings = [s for s, _ in pairs]
        want = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in "abzé"} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in "abzé"}
        assert len(strings) == len(set(strings)) and set(strings) == want - {word}
        assert all(word_hashes([s])[0] == h for s, h in pairs if s)
