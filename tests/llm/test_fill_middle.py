import hashlib
import re

import numpy as np
import pytest
from tidemill.llm import fill_middle as fm

from ..duck import compare

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm=80, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_whole_table(spark):
    got = compare(spark, "/root/testdata/sf0.01", fm.op12_fill_in_middle, fm.oracle())
    assert len({r[1] for r in got}) == 3  # all forms


ODD = ["", None, " ", "a", " a", "a ", "  a  b\t\n", "\x0b\x0c\r", "é  ü漢字 😀 x", "x <P> y", "<", "<P", "a <S>", "<M", ">P> <", "a<" * 9, "  a\u0085b ", "ab " * 30_000, "w" * 300_000 + " ", "漢" * 1000 + "é" * 7 + "z"]


@pytest.mark.parametrize("unit", ["token", "char"])
def test_odd_texts(spark, unit):
    rows = [(i, t) for i in (0, 1, 2, 3, 7, 11, 12, 40, 41, -5, None) for t in ODD] + [(2, "same text again")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "2 as output")
    made = fm.fill_in_middle(df, rate=100, spm=50, unit=unit)
    got = made.withColumn("restored", fm.restored(made["output"], made["form"])).collect()
    want = [(*brute(i, t, rate=100, spm=50, unit=unit), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_runs_and_places():
    data = np.frombuffer("ab  éé c ".encode(), np.uint8)
    starts, ends, units = fm.class_runs(data)
    assert list(zip(starts.tolist(), ends.tolist(), units.tolist(), strict=True)) == [(0, 2, 1), (2, 4, 0), (4, 8, 1), (8, 9, 0), (9, 10, 1), (10, 11, 1)]
    runs = fm.class_runs(data, "char")
    upto = np.cumsum(runs[2])
    assert [fm.place(runs, upto, k) for k in range(10)] == [0, 1, 2, 3, 4, 6, 8, 9, 10, 11]
    with pytest.raises(ValueError, match="unknown unit"):
        fm.class_runs(data, "page")


def test_empty_table(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
