import math
import random
import zlib
from collections import Counter

import numpy as np
from tidemill.llm import brown_lm as b
from tidemill.llm.brown_lm import exchange, fit, op3_lm_score, score

from .test_minhash_dedup import thue_morse


def words(t):
    return (t or "").encode().lower().split()


def base(rows):
    """The contract's base figures, in plain Python."""
    held = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*words(t), None]
        out.append((i, held[i], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=str)


def check(rows, got):
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == base(rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op3_lm_score(spark, sf).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    print(sum(r.score for r in held), sum(r.base_score for r in held))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_small_head(spark, sf, monkeypatch):
    for name, value in (("CORE", 40), ("NEAR", 200), ("HEAD", 500), ("CLASSES", 8)):
        monkeypatch.setattr(b, name, value)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, op3_lm_score(spark, sf).collect())


def test_probabilities_sum_to_one(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(30)], k=20))) for k in range(60)]
    model, tail = fit(spark.createDataFrame(rows, "doc_id long, text string"))
    ask = spark.createDataFrame([(k, w) for k, w in enumerate([*vocabulary, "new", ""])], "doc_id long, text string").selectExpr("*", "false as held_out")
    got = {r.doc_id: r.score for r in score(ask, model, tail).collect()}
    end = {c: 10 ** model.transition[c, model.end] for c in range(model.end + 1)}
    seen = {len(words(t)) for _, t in rows}
    assert seen == {20}
    labels = {w: int(model.labels[b.opened(model.lookup)(next(b.tokens([w]))[1])[0]]) for w in vocabulary}
    total = sum(10 ** got[k] / end[labels[w]] for k, w in enumerate(vocabulary)) + 10 ** got[30] / end[model.end - 1] + 10 ** got[31]
    unseen = set(range(model.end + 1)) - set(labels.values()) - {model.end, model.end - 1}
    total += sum(10 ** model.transition[model.end, c] for c in unseen)
    assert abs(total - 1) < 1e-6


def test_exchange_finds_two_languages():
    rng = np.random.default_rng(4)
    pairs = np.zeros((22, 22))
    for side in (0, 10):
        pairs[side : side + 10, side : side + 10] = rng.integers(5, 50, (10, 10))
    label = exchange(pairs, 20, 2)
    assert len(set(label[:10])) == 1 and len(set(label[10:])) == 1 and label[0] != label[10]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A a B"), (4, "A a B"), (None, "x"), (7, "z " * 50_000), (8, "a\x1cb \x85 é"), (9, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as row_id", "4 as tail")
    asked = df.withColumn("held_out", b.crc_remainder("doc_id", 7) == 2)
    model, tail = fit(asked.where("not held_out"))
    check(rows, score(asked, model, tail).collect())
    model, tail = fit(df.limit(0))
    assert all(r.n_known == 0 and r.base_score == 0 for r in score(asked, model, tail).collect())
    assert score(asked.limit(0), model, tail).count() == 0


def plain_score(rows, model, classes, asked):
    """The score of each asked text by plain loops, from the classes of the words."""
    held = [words(t) for _, t in rows]
    count = Counter(w for t in held for w in t)
    label = lambda w: model.end if w is None else classes.get(w, model.end - 1)
    steps = Counter(p for t in held for p in zip([None, *t], [*t, None], strict=True))
    grid = np.zeros((model.end + 1, model.end + 1))
    for (a, b), n in steps.items():
        grid[label(a), label(b)] += n
    share = (grid.sum(axis=0) + 1) / (grid.sum() + model.end + 1)
    tail = {w: n for w, n in count.items() if w not in classes}
    mass = Counter()
    for w, c in classes.items():
        mass[c] += count[w]

    def token(a, b):
        i, j = label(a), label(b)
        p = math.log10((grid[i, j] + 10 * share[j]) / (grid[i].sum() + 10))
        if b is None:
            return p
        if b in classes:
            return p + math.log10(count[b] / mass[j])
        return p + math.log10((tail.get(b, 0) + 1) / (sum(tail.values()) + len(tail) + 1))

    return [sum(token(a, b) for a, b in zip([None, *words(t)], [*words(t), None], strict=True)) for t in asked]


def test_scores_match_plain_loops(spark, sf, monkeypatch):
    for name, value in (("CORE", 60), ("NEAR", 300), ("HEAD", 1500), ("CLASSES", 8)):
        monkeypatch.setattr(b, name, value)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    train, asked = rows[:90], [t for _, t in rows]
    model, tail = fit(spark.createDataFrame(train, "doc_id long, text string"))
    names = sorted({w for _, t in train for w in words(t)})
    at = b.opened(model.lookup)(np.concatenate([next(b.tokens([w.decode()]))[1] for w in names]))
    classes = {w: int(model.labels[k]) for w, k in zip(names, at.tolist(), strict=True) if k >= 0}
    assert len({c for c in classes.values() if c < 8}) == 8 and 300 < len(classes) < len(names)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "false as held_out")
    got = {r.doc_id: r.score for r in score(frame, model, tail).collect()}
    want = plain_score(train, model, classes, asked)
    assert all(abs(got[i] - w) < 1e-6 * max(1, abs(w)) for (i, _), w in zip(rows, want, strict=True))


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(8)
    grid = rng.integers(0, 40, (5, 5)).astype(float)
    before, after = rng.integers(0, 9, (3, 5)).astype(float), rng.integers(0, 9, (3, 5)).astype(float)

    def likelihood(g):
        x = lambda v: float((v * np.log(np.maximum(v, 1))).sum())
        return x(g) - x(g.sum(axis=0)) - x(g.sum(axis=1))

    got = b.gains(grid, before, after, 4)
    for i in range(3):
        plain = []
        for k in range(4):
            g = grid.copy()
            g[k] += after[i]
            g[:, k] += before[i]
            plain.append(likelihood(g))
        assert np.allclose(got[i] - got[i][0], np.array(plain) - plain[0])


def test_structured_words_differ(spark):
    x, y = thue_morse()
    rows = [(1, x), (2, y), (3, f"{x} q")]
    asked = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id = 2 as held_out")
    model, tail = fit(asked.where("not held_out"))
    assert {r.doc_id: r.n_known for r in score(asked, model, tail).collect()} == {1: 2, 2: 1, 3: 3}
