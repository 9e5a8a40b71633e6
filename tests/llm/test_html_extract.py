import html as entities
import re
import time
import tracemalloc

import numpy as np
from tidemill.llm import html_extract as h
from tidemill.llm.html_extract import extract, op2_html_extract


def article(page):
    """The main text of the given tables' pages, whose articles are plain."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    inner = re.sub(r"<[^>]*(>|\Z)", lambda t: "" if re.match(r"</?b>", t[0]) else " ", m[1]) if m else ""
    return " ".join(entities.unescape(inner).split())


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in h.start_weights(rng).items()}
    x, live = h.pad([rng.normal(size=(5, h.INPUT)).astype(np.float32), rng.normal(size=(3, h.INPUT)).astype(np.float32)])
    y = rng.integers(0, 2, live.shape).astype(np.float32)

    def loss():
        p = np.clip(h.forward(w, x, live)[0], 1e-12, 1 - 1e-12)
        return -(np.where(live, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / live.sum()

    g = h.gradients(w, x, live, y)
    for name in w:
        at = np.unravel_index(np.abs(g[name]).argmax(), w[name].shape)
        keep, step = w[name][at], 1e-2
        w[name][at] = keep + step
        up = loss()
        w[name][at] = keep - step
        down = loss()
        w[name][at] = keep
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-3 + 0.02 * abs(g[name][at]), name


def test_blocks_of_broken_pages():
    got = [t for _, t, _ in h.blocks('<title>T</title><script>var t="</p>";</script><p>a <b>b<br>c<p>d&amp;e &#233;&nbsp;f</div><!-- x --><ul><li>g<li>h</ul>i < j <fo')]
    assert got == ["T", "a b c", "d&e é f", "g", "h", "i < j"]
    assert h.blocks("") == [] and h.blocks("<<<>>>")[0][1]
    assert len(h.blocks("<div>" * 3000 + "x" + "</div>" * 3000)) == 1


def test_held_out_layouts():
    maker, w, right, total = h.PageMaker(4711), h.trained(), 0, 0
    for _ in range(300):
        found, y = h.labelled(maker.page())
        if found:
            x, live = h.pad([h.features(found)])
            right += ((h.forward(w, x, live)[0][:, 0] >= 0.5) == y.astype(bool)).sum()
            total += len(y)
    assert right > 0.99 * total


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op2_html_extract(spark, sf).collect()
    assert len(got) == len(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in got)
    assert sum(r.text == article(pages[r.page_id].html) for r in got) >= 0.99 * len(got)


def test_edges(spark):
    one = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title</h1><p>Some text of it.</p></article><footer>&copy; me</footer></body></html>"
    long = one.replace("Some text of it.", "</p><p>".join(["Some text of it."] * 4000))
    rows = [(1, "u", None), (2, None, ""), (None, "v", one), (3, "w", one), (3, "w", one), (4, "x", long), (5, "y", "<nav>only"), (6, "z", "   ")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in extract(df).collect()]
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r[2] for r in got}
    assert by[1, "u"] == by[2, None] == by[6, "z"] == ""
    assert by[3, "w"] == by[None, "v"] == "A title Some text of it."
    assert by[4, "x"] == " ".join(["A title", *["Some text of it."] * 4000])
    assert extract(df.limit(0)).count() == 0


def test_custom_elements_are_no_raw_elements():
    for name in ("video-js", "svg-icon", "audio-player", "select-menu", "object-view", "math-field", "scripted"):
        assert [t for _, t, _ in h.blocks(f"<p>one</p><{name} id=v></{name}><p>two</p>")] == ["one", "two"], name
    assert [t for _, t, _ in h.blocks("<p>a</p><svg/><select\n><option>no</select><p>b</p><svg")] == ["a", "b"]
    assert [t for _, t, _ in h.blocks("<p>so <object data=x>a picture</object> shows</p><video src=x>no <b>video</b> here</video>")] == ["so a picture shows", "no video here"]


def test_formulas_are_text():
    page = '<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="application/x-tex">x=2</annotation></semantics></math> holds</p>'
    assert h.blocks(page) == [(h._bit("t:p") | h._bit("l:p"), "so x=2 holds", 0)]


def test_deep_nesting():
    deep = lambda inner: "<div>" * 30 + inner + "</div>" * 30
    one = "<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title</h1>{}</article><section class=comments>{}</section><footer>&copy; me</footer>"
    text, reply = "<p>Some text of it. It goes on.</p>" * 3, "<p>I think so too.</p>" * 3
    pages = [one.format(deep(text), deep(reply)), one.format(text, reply)]
    found = h.blocks(pages[0])
    assert all(h._bit("n:comment") & p for p, t, _ in found if t == "I think so too.")
    assert all(h._bit("t:article") & p for p, t, _ in found if t.startswith("Some"))
    got = h.main_texts(h.trained(), pages)
    assert got[0] == got[1] == "A title" + " Some text of it. It goes on." * 3


def test_deep_and_long_pages_stay_cheap():
    began = time.time()
    assert len(h.blocks("<div>x" * 50_000)) == 50_000
    assert len(h.blocks("<b>" * 50_000 + "<div>x</div></i>" * 50_000)) == 50_000
    assert time.time() - began < 10
    small_page = "<article><p>Some text of it. It goes on.</p></article>"
    long_page = "<article>" + "<p>Some text of it. It goes on.</p>" * 200_000 + "</article>"
    w = h.trained()
    tracemalloc.start()
    got = h.main_texts(w, [small_page] * 63 + [long_page])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == "Some text of it. It goes on." and got[63].count("Some") == 200_000
    assert most < 500 << 20


# Pages written by hand, none from the maker.
P1 = "The kerf is the slot that a saw leaves behind in the wood. It is as wide as the teeth are set."
P2 = "A thin blade wastes less timber, but it bends when the cut is deep."
P3 = "Most workshops keep three saws and sharpen them once a month."
HEAD = "<html><head><title>Saws</title></head><body>"
NAV = '<nav><a href="/">Home</a> <a href="/about">About</a> <a href="/contact">Contact</a></nav>'
FOOT = "<footer><p>© 2024 Sawyers Ltd. All rights reserved.</p></footer>"
PAGES = [
    (f"{HEAD}{NAV}<article><h1>Saws</h1><p>{P1}</p><dl><dt>Kerf</dt><dd>The width of a cut.</dd><dt>Set</dt><dd>How far teeth lean out.</dd></dl><p>{P2}</p></article>{FOOT}</body></html>",
     f"Saws {P1} Kerf The width of a cut. Set How far teeth lean out. {P2}"),
    (f"{HEAD}{NAV}<article><h1>Saws</h1><dl><dt>Kerf</dt><dd>The width of a cut.</dd></dl></article>{FOOT}</body></html>", "Saws Kerf The width of a cut."),
    (f"{HEAD}{NAV}<article><h1>Saws</h1><p>{P1}</p><details><summary>More on blades</summary><p>{P2}</p></details></article>{FOOT}</body></html>", f"Saws {P1} More on blades {P2}"),
    (f"{HEAD}<article><p>{P1}</p><table><tr><th>Blade</th><th>Width</th></tr><tr><td>Rip</td><td>3 mm</td></tr></table><p>{P2}</p></article>{FOOT}</body></html>", f"{P1} Blade Width Rip 3 mm {P2}"),
    (f"<table><tr><th>Blade</th><th>Width</th></tr><tr><td>Rip</td><td>3 mm</td></tr></table>", "Blade Width Rip 3 mm"),
    (P1, P1),
    (f"{P1}\n\n{P2}", f"{P1} {P2}"),
    (f"<div>{P1}</div>", P1),
    (f"<html><body><div>{P1}</div></body></html>", P1),
    (f"<p>{P1}</p><p>{P2}</p>", f"{P1} {P2}"),
    (f'<html><body><div class="x1"><a href="/">Home</a> <a href="/a">About</a></div><div class="x2"><h1>Saws</h1><p>{P1}</p><p>{P2}</p></div><div class="x3">© 2024 Sawyers Ltd. All rights reserved.</div></body></html>', f"Saws {P1} {P2}"),
    (f'<html><body><div class="q7"><h1>Saws</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class="z"><p>Copyright 2023 Sawyers Ltd. Privacy policy. Terms of service.</p></div></body></html>', f"Saws {P1} {P2} {P3}"),
    (f'<html><body><div class="a8f"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></div><div class="b2c"><h1>On saws</h1><p>{P1}</p><p>{P3}</p></div><div class="d4e">© Sawyers</div></body></html>', f"On saws {P1} {P3}"),
    (f'{HEAD}{NAV}<article><h1>Saws</h1><p>{P1}</p><p hidden>Draft note for editors.</p><p style="display: none">Old text.</p><p class="hidden-gem">{P2}</p></article>{FOOT}</body></html>', f"Saws {P1} {P2}"),
    (f'{HEAD}<script src="x.js"/>var a = "<p>no</p>";</script>{NAV}<article><h1>Saws</h1><p>{P1}</p><script src="y.js"/>track();</script><p>{P2}</p></article>{FOOT}</body></html>', f"Saws {P1} {P2}"),
    (f'{HEAD}{NAV}<script src="x.js" /><article><h1>Saws</h1><p>{P1}</p></article>{FOOT}</body></html>', f"Saws {P1}"),
    (f'{HEAD}{NAV}<main><h1>Saws</h1><p>{P1}</p><p>{P2}</p></main><section class="comments"><h3>Comments</h3><p>Great read, thanks!</p><p>I prefer axes.</p></section>{FOOT}</body></html>', f"Saws {P1} {P2}"),
    (f'{HEAD}{NAV}<div class="sidebar"><h3>Popular posts</h3><ul><li><a href=/1>Axes</a></li></ul></div><div class="content"><p>{P1}</p><ol><li>Mark the line.</li><li>Cut beside it.</li></ol></div>{FOOT}</body></html>', f"{P1} Mark the line. Cut beside it."),
    (f"{NAV}{FOOT}", ""),
]


def test_pages_by_hand():
    for (page, want), got in zip(PAGES, h.main_texts(h.trained(), [page for page, _ in PAGES]), strict=True):
        assert got == want, page


def test_script_ends_at_its_end_tag():
    texts = lambda page: [t for _, t, _ in h.blocks(page)]
    assert texts('<p>a</p><script src="x.js"/>var t = "<p>no</p>";</script><p>b</p>') == ["a", "b"]
    assert texts('<p>a</p><script src="x.js"/><p>b</p>') == ["a", "b"]
    assert texts("<p>a</p><script>var t = 1;<p>b</p>") == ["a"]
    began = time.time()
    assert len(texts("<script/><p>x</p>" * 20_000)) == 20_000
    assert time.time() - began < 10


def test_hidden_elements_are_no_text():
    texts = lambda page: [t for _, t, _ in h.blocks(page)]
    assert texts("<p hidden>a<p>b<div HIDDEN=''><p>c</p><b>d</b></div>e") == ["b", "e"]
    assert texts("<div style='color:red; display : none'>a</div><p style=\"visibility:hidden\">b</p><p style=display:none>c</p>d") == ["d"]
    assert texts("<p class=hidden>a</p><p class='x hidden y'>b</p><p data-hidden>c</p><p title='display:none'>d</p>") == ["a", "b", "c", "d"]


def test_weights_are_kept(spark):
    own, h._TRAINED[:] = h.trained(), []
    once = h.train
    try:
        h.train = lambda: own
        assert h.trained(spark) is own
        h._TRAINED[:] = []
        h.train = None  # must not be called again
        read = h.trained(spark)
    finally:
        h.train, h._TRAINED[:] = once, [own]
    assert read.keys() == own.keys() and all((read[k] == own[k]).all() for k in own)
