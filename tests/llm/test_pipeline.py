from collections import Counter

import corpus_pipeline as p
from tidemill.llm.mixing import mixed_sizes

from .test_minhash_dedup import brute as groups
from .test_secret_scan import brute as secrets


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    lang = p.language_stage(spark, docs, sf)
    assert lang.columns == docs.columns
    kept = {r.doc_id for r in lang.collect()}
    assert all(any(c.isalpha() for c in rows[k].text) for k in kept)
    assert len(kept) >= sum(len(r.text.split()) >= 5 and any(c.isalpha() for c in r.text) for r in rows.values()) * 0.99

    lang = lang.cache()
    want = {d for d, _, _, keep in groups([(k, rows[k].text) for k in kept], 5, (4, 5)) if keep}
    unique = p.dedup_stage(spark, lang, sf)
    assert unique.columns == docs.columns
    assert sorted(r.doc_id for r in unique.collect()) == sorted(want)

    unique = unique.cache()
    clean = p.secret_stage(spark, unique, sf)
    assert clean.columns == docs.columns
    changed = 0
    for r in clean.collect():
        spans = secrets(rows[r.doc_id].text)[4]
        changed += bool(spans)
        assert (r.text != rows[r.doc_id].text) == bool(spans) and r.n_chars == len(r.text)
        assert not spans or secrets(r.text)[4] == ""
    assert changed

    clean = clean.cache()
    mixed = p.mixing_stage(spark, clean, sf)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixed_sizes(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(copies)

    tokens = p.token_stage(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in tokens) == Counter(copies)
    assert all(r.exact and r.n_ids == len(r.ids) for r in tokens)


def test_edges(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, ids string, base string, score int, mix_n int, spans int, _id int"
    rows = [(1, None, None, None, None, "a", "b", 1, 2, 3, 4), (2, "", "en", "s", 0, None, None, None, None, None, None), (3, "word " * 50, "en", "s", 250, "x", "y", 1, 2, 3, 4), (3, "word " * 50, "en", "s", 250, "x", "y", 1, 2, 3, 4), (4, "wort und " * 40, "de", None, 5, None, None, None, None, None, None), (None, "mots et " * 30, None, "t", 1, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, kinds)
    for table in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            table = (out := stage(spark, table, "")).cache()
            assert name == "sentencepiece" or out.columns == docs.columns
        assert all(r.exact for r in table.collect())
    assert len(p.STAGES) == 5
