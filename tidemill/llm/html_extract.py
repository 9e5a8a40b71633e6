"""Main text of HTML pages by a recurrent block labeller.

Method: a page becomes its sequence of leaf blocks (text between block-level tags, inline tags removed). Each block has a
vector of hashed tag-path features (tags, words of class, id and role along the whole path, as a set of bits that grows
with each open element, so depth costs nothing), how many elements closed and opened since the block before, hashed words
and a few measures. A bidirectional LSTM in numpy reads the whole sequence, so every block is labelled with the context of the whole document.
Main blocks are joined in page order.

The labeller is trained by the driver, in some seconds and with fixed seeds, on PAGES synthetic pages whose labels are
known by construction: many layouts of article, navigation, header, footer, sidebar, notice, advert, form and comments,
with plain and semantic markup, made-up words in all of them. Some pages have names that say nothing, so only words and
shape tell there; some are bare text or one block. That sample is bounded and does not depend on the corpus. The weights
(about 500 KB) are kept in the shared folder under a digest of this module and broadcast; pages are labelled where they are read, without any shuffle, some thousands of
blocks at a time; one page of n blocks takes some 700 n bytes.

Edge cases: null and empty html give '' with 0 characters. Unclosed, crossing and cut-off tags, comments and raw elements
are read as browsers mostly do, custom elements such as video-js as any other element; formulas are text without their
annotations, elements with hidden, display:none or visibility:hidden in their attributes are no text; script and the
like end at their end tag, whatever slash their start tag has; what stands inside of video, audio, object or canvas is text; an unfinished tag at the end is dropped, text outside of tags is text. Rows are
independent of each other: equal rows give equal results. An empty table gives an empty result. Only page_id, url and html
are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import inspect
import random
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_hashes, lean, records, shared_dir, small, word_bounds

PATH, STEPS, WORDS, MEASURES, HIDDEN = 512, 16, 64, 8, 20
PAGES, EPOCHS, BATCH, RATE, SEED = 4000, 12, 40, 0.02, 11
#: The weights are the mean of those after each step of this many last epochs.
MEAN = 3
INPUT = PATH + STEPS + WORDS + MEASURES
#: Blocks, padding included, that are labelled at a time, but for a single longer page.
CELLS = 1 << 14

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|iframe|svg|textarea|select|annotation(?:-xml)?)(?=[\s/>]|\Z)[^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose content is no text, and those of them that a slash closes; for others browsers read on to the end tag.
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style template noscript iframe svg textarea select annotation annotation-xml".split()}
_SLASHED = ("svg", "annotation", "annotation-xml")
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i kbd mark nobr q s samp small span strike strong sub sup time tt u var math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?=[\s=/]|$)""", re.I)
_UNSEEN = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*?|'[^']*?|[^\s"']*?)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def blocks(html: str, masks: dict | None = None) -> list[tuple[int, str, int]]:
    """Path features as bits, text and link characters of each leaf block that has text. masks: features seen before."""
    masks = {} if masks is None else masks
    out, parts, at, links = [], [], 0, 0
    stack: list[tuple] = []  # name, features of all elements so far, those of the path, last block's place, name before, hidden
    endless: set[str] = set()  # raw elements without an end tag from here on
    count: dict[str, int] = {}  # of open elements by name
    path, depth, last, low = _ROOT, 0, 0, 0  # depth of this block and the last, the least depth between them

    def flush():
        nonlocal parts, links, last, low
        text = " ".join("".join(parts).split())
        if text:
            steps = _steps(last - low, depth - low) if out else 0
            out.append((path | steps, text, min(links, len(text))))
            last = low = depth
        parts, links = [], 0

    def add(raw: str):
        nonlocal path, links, depth, low
        if stack and stack[-1][5]:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if not parts or path == _ROOT and text.strip():
            path, depth = stack[-1][2] if stack else _ROOT, len(stack)
            low = min(low, depth)
        parts.append(text)
        if any(s[0] == "a" for s in stack[-3:]):
            links += len(text)

    def close(to: int):
        nonlocal low
        low = min(low, to)
        for x in stack[to:]:
            count[x[0]] -= 1
        del stack[to:]

    while m := _MARKUP.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[1]:
            at = _raw_end(html, m[1].lower(), at, m[0].endswith("/>"), endless)
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, given = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if name == "br":
            parts.append(" ")
        elif name in _VOID:
            if name in _BLOCKS:
                flush()
        elif closing:
            if count.get(name):
                if name in _BLOCKS:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
        else:
            if name in _BLOCKS:
                flush()
                if stack and (k := stack[-1][3]) >= 0 and (stack[k][0] == "p" or stack[k][0] in _CLOSES.get(name, ())):
                    close(k)
            if not given.rstrip().endswith("/"):
                all_, shown, block, before, unseen = stack[-1][1:] if stack else (0, _ROOT, -1, "", False)
                if name not in _INLINE:
                    all_ |= _mask(masks, name, given)
                    shown = all_ | _bit(f"l:{name}") | (_bit(f"l:{before}") if before else 0)
                    before = name
                unseen = unseen or bool(given) and _unseen(given)
                stack.append((name, all_, shown, len(stack) if name in _BLOCKS else block, before, unseen))
                count[name] = count.get(name, 0) + 1
    if at < len(html):
        add(html[at:])
    flush()
    return out


def _raw_end(html: str, name: str, at: int, slashed: bool, endless: set[str]) -> int:
    """Where a raw element ends whose start tag ends at at. One closed by a slash that never ends is taken as empty."""
    if slashed and name in _SLASHED:
        return at
    end = None if name in endless else _RAW[name].search(html, at)
    if end:
        return end.end()
    endless.add(name)
    return at if slashed else len(html)


def _unseen(given: str) -> bool:
    """Whether attributes say that an element is not shown."""
    return "hidden" in given.lower() and bool(_HIDDEN.search(_QUOTED.sub('""', given)) or _UNSEEN.search(given)) or "none" in given.lower() and bool(_UNSEEN.search(given))


# ---- features ------------------------------------------------------------------------------------------------------

_ROOT = 0


def _bin(text: str, size: int) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) * 2654435761 % (1 << 32) * size >> 32


def _bit(text: str) -> int:
    return 1 << _bin(text, PATH)


def _mask(masks: dict, tag: str, given: str) -> int:
    """The features of one element."""
    if (tag, given) not in masks:
        if len(masks) > 20_000:
            masks.clear()
        out = _bit(f"t:{tag}")
        for m in _NAMED.finditer(given):
            for word in _PARTS.findall(m[2] or m[3] or m[4] or ""):
                if len(word) < 2:
                    continue
                word = word.lower().removesuffix("s")
                out |= _bit(f"n:{word}") | _bit(f"m:{word}")  # of two bits a name that means nothing seldom has both of one that does
        masks[tag, given] = out
    return masks[tag, given]


def _steps(closed: int, opened: int) -> int:
    """Features of the elements closed and opened since the block before."""
    return 1 << PATH + min(closed, STEPS // 2 - 1) | 1 << PATH + STEPS // 2 + min(opened, STEPS // 2 - 1)


def path_features(paths: list[int]) -> np.ndarray:
    size = (PATH + STEPS) // 8
    raw = np.frombuffer(b"".join(p.to_bytes(size, "little") for p in paths), np.uint8).reshape(-1, size)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)


def text_features(found: list[tuple[int, str, int]]) -> np.ndarray:
    x = np.zeros((len(found), WORDS + MEASURES), np.float32)
    raw = [t.lower().encode() for _, t, _ in found]
    ends = np.cumsum([len(b) + 1 for b in raw])
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    starts, stops = word_bounds(data)
    owner = np.searchsorted(ends, starts, "right")
    bins = (byte_hashes(data, starts, stops) >> np.uint64(58)).astype(np.int64)
    count = np.bincount(owner, minlength=len(found))
    # a word said over and over counts twice at most, one that stands alone a third
    x[:, :WORDS] = np.minimum(np.bincount(owner * WORDS + bins, minlength=len(found) * WORDS), 2).reshape(-1, WORDS) / np.maximum(count, 3)[:, None]
    n = len(found)
    for k, (_, text, links) in enumerate(found):
        size = len(text)
        x[k, WORDS:] = (
            np.log1p(size) / 6, np.log1p(count[k]) / 4, links / size, text[-1] in ".!?:\"»”", "©" in text, sum(map(text.count, ".,;!?")) / size * 10, k / n, 1.0,
        )
    return x


def features(found: list[tuple[int, str, int]]) -> np.ndarray:
    """All features of the blocks of a page, as training takes them."""
    return np.hstack((path_features([p for p, _, _ in found]), text_features(found))) if found else np.zeros((0, INPUT), np.float32)


# ---- the network ---------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.08, (INPUT, 4 * HIDDEN)).astype(np.float32)
        w[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        w[f"c{d}"] = bias
    w["out"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
    w["off"] = np.zeros(1, np.float32)
    return w


def _scan(w: dict, d: str, gates: np.ndarray, live: np.ndarray, keep: bool):
    """One direction over padded sequences of gate inputs, time first; padding leaves the state as it is."""
    steps, n, _ = gates.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, trail = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = gates[t] + h @ w[f"h{d}"]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        m = live[t][:, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep:
            trail.append((t, h, c, i, f, o, g, tanh, m))
        c = np.where(m, new, c)
        h = np.where(m, o * tanh, h)
        hs[t] = h
    return hs, trail


def forward(w: dict, x: np.ndarray, live: np.ndarray, keep: bool = False):
    return _forward(w, {d: x @ w[f"x{d}"] + w[f"c{d}"] for d in "fb"}, live, keep)


def _forward(w: dict, gates: dict[str, np.ndarray], live: np.ndarray, keep: bool = False):
    f, trail_f = _scan(w, "f", gates["f"], live, keep)
    b, trail_b = _scan(w, "b", gates["b"], live, keep)
    both = np.concatenate((f, b), axis=2)
    return _sigmoid(both @ w["out"] + w["off"]), both, {"f": trail_f, "b": trail_b}


def gradients(w: dict, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, both, trails = forward(w, x, live, keep=True)
    d_out = np.where(live, p - y, 0).astype(np.float32) / live.sum()
    grad = {"out": np.einsum("tnh,tn->h", both, d_out), "off": d_out.sum(keepdims=True).reshape(1)}
    d_both = d_out[:, :, None] * w["out"]
    for d, part in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh, dc, grad_h = 0.0, 0.0, np.zeros_like(w[f"h{d}"])
        for t, h, c, i, f, o, g, tanh, m in reversed(trails[d]):
            dh = dh + part[t]
            d_new = np.where(m, dc + dh * o * (1 - tanh * tanh), 0)
            dz = np.concatenate((d_new * g * i * (1 - i), d_new * c * f * (1 - f), np.where(m, dh * tanh, 0) * o * (1 - o), d_new * i * (1 - g * g)), axis=1).astype(np.float32)
            dz_all[t] = dz
            grad_h += h.T @ dz
            dh = np.where(m, dz @ w[f"h{d}"].T, dh)
            dc = np.where(m, d_new * f, dc)
        grad[f"h{d}"], grad[f"c{d}"] = grad_h, dz_all.sum(axis=(0, 1))
        grad[f"x{d}"] = x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * HIDDEN)
    return grad


def pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, sequences))
    x, live = np.zeros((steps, len(sequences), INPUT), np.float32), np.zeros((steps, len(sequences)), bool)
    for k, s in enumerate(sequences):
        x[: len(s), k] = s
        live[: len(s), k] = True
    return x, live


# ---- training pages ------------------------------------------------------------------------------------------------

MARK = ""
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve sch ung ich keit ein ión ado que ment eau tion é ü ß ñ ç".split()
_CUES = {
    "footer": ["©", "copyright", "all rights reserved", "privacy policy", "terms of service", "imprint", "&copy;", "© 2024", "copyright 2023", "contact us"], "notice": ["we use cookies", "accept cookies", "this site uses cookies", "warning", "sign in to continue", "please log in"], "ad": ["buy now", "sponsored", "advertisement", "special offer", "sale", "deal"],
    "form": ["email", "subscribe", "send", "search", "your name", "password", "sign up", "submit"], "comments": ["reply", "posted by", "says", "comment", "likes", "reply", "wrote"], "nav": ["home", "about", "contact", "news", "menu", "login", "products", "blog"], "header": ["home", "blog", "daily", "welcome"], "sidebar": ["related", "popular posts", "recent posts", "tags", "share", "read more", "related posts"],
}
_NAMES = {
    "nav": ["nav", "navbar", "menu", "main-menu", "topnav", "breadcrumb", "navigation", "links", "pagination"], "header": ["header", "site-header", "masthead", "banner", "top", "logo"], "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"], "sidebar": ["sidebar", "side", "widget", "related", "aside", "right-col", "recommended", "share", "social", "tags", "popular"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "alert", "consent", "message", "popup", "modal", "gdpr", "warning"], "ad": ["ad", "ads", "advert", "advertisement", "promo", "sponsored", "sponsor", "ad-slot", "banner-ad"], "form": ["form", "search-form", "newsletter", "login", "subscribe", "signup", "contact-form"], "comments": ["comments", "comment-list", "comment", "discussion", "responses", "disqus", "replies", "user-comments"],
    "main": ["content", "main", "post", "entry", "entry-content", "article", "article-body", "story", "post-content", "text", "body", "main-content", "post-body", "page-content"], "plain": ["container", "wrap", "row", "col", "inner", "page", "box", "layout", "grid", "outer", "site", "section"],
}
_ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search", "main": "main"}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "section", "aside", "p", "dialog"], "ad": ["div", "div", "aside", "section", "ins"], "form": ["form"], "comments": ["section", "div", "ul", "ol"]}


class PageMaker:
    """Pages with known labels: the text of a main block starts with MARK."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.pool = ["".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(5000)]
        self.opaque = False  # whether names and tags of the page say nothing

    def word(self) -> str:
        return self.r.choice(self.pool)

    def words(self, low: int, high: int) -> str:
        n, style = self.r.randint(low, high), self.r.random()
        out = self.r.choices(self.pool, k=n)
        if style < 0.08:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.15:
            out = [w + self.r.choice(("***", "###", "&amp;&amp;", "$$$")) for w in out]
        elif style < 0.2:
            out = [self.word()] * n
        text = " ".join(out)
        return text[:1].upper() + text[1:] + self.r.choice((".", ".", ".", "", "?"))

    def paragraph(self) -> str:
        if self.r.random() < 0.15:
            return self.words(1, 3)
        text = " ".join(self.words(1, 25) for _ in range(self.r.choice((1, 1, 2, 3, 5))))
        if self.r.random() < 0.2:
            text += f" <{(i := self.r.choice(('b', 'i', 'em', 'strong', 'span')))}>{self.words(1, 4)}</{i}> {self.words(1, 6)}"
        if self.r.random() < 0.15:
            text += f' <a href="/{self.word()}">{self.words(1, 3)}</a> {self.words(1, 6)}'
        if self.r.random() < 0.1:
            text = text.replace(". ", ".<br>", 1)
        if self.r.random() < 0.06 and not self.opaque:  # an article may say so too
            text = self.r.choice((text + " ", "")) + self.r.choice(_CUES[self.r.choice(list(_CUES))]).capitalize() + "."
        return ("<b>" if self.r.random() < 0.12 else "") + text

    def attr(self, kind: str) -> str:
        name, r = self.r.choice(_NAMES[kind]), self.r.random()
        if self.opaque:
            return self.r.choice(("", f' class="{self.word()}"', f' class="x{self.r.randint(1, 99)}"', f' class="css-{self.word()}{self.r.randint(1, 9)}"', f' id="{self.word()}"'))
        if r > 0.93:
            return ""
        if kind in _ROLES and self.r.random() < 0.07:
            return f' role="{_ROLES[kind]}"'
        if r < 0.55:
            return f' class="{name}"' if self.r.random() < 0.7 else f' class="{self.word()} {name}"'
        return f' id="{name}"' if r < 0.75 else f" class='{name} {self.word()}' id=\"{self.word()}\"" if r < 0.85 else f' class="{name}-{self.word()}"'

    def main(self) -> str:
        out = []
        if self.r.random() < 0.8:
            title = f"<h1>{MARK}{self.words(2, 10)}</h1>"
            out.append(f"<header>{title}</header>" if self.r.random() < 0.12 else title)
        for _ in range(self.r.choice((1, 2, 3, 4, 6, 9, 14, 25))):
            r = self.r.random()
            if r < 0.7:
                tag = "p" if self.r.random() < 0.9 else "div"
                out.append(f"<{tag}>{MARK}{self.paragraph()}" + (f"</{tag}>" if tag == "div" or self.r.random() < 0.85 else ""))
            elif r < 0.78:
                out.append(f"<h{self.r.choice('23')}>{MARK}{self.words(1, 6)}</h2>")  # some end tags do not fit
            elif r < 0.83:
                kind = self.r.choice(("ul", "ol"))
                out.append(f"<{kind}>" + "".join(f"<li>{MARK}{self.words(1, 15)}</li>" for _ in range(self.r.randint(1, 5))) + f"</{kind}>")
            elif r < 0.86:
                out.append(f"<blockquote>{MARK}{self.words(4, 25)}</blockquote>")
            elif r < 0.9:
                out.append(self.table())
            elif r < 0.92:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.words(2, 10)}</figcaption></figure>")
            elif r < 0.94:
                out.append(f"<pre>{MARK}{self.words(2, 20)}</pre>")
            elif r < 0.97:
                out.append("<dl>" + "".join(f"<dt>{MARK}{self.words(1, 4)}</dt><dd>{MARK}{self.words(1, 15)}</dd>" for _ in range(self.r.randint(1, 4))) + "</dl>")
            else:
                out.append(f"<details{self.r.choice(('', ' open'))}><summary>{MARK}{self.words(1, 6)}</summary><p>{MARK}{self.paragraph()}</p></details>")
        if self.r.random() < 0.05:
            out = [f"<section>{x}</section>" if self.r.random() < 0.5 else x for x in out]
        for kind in ("ad", "sidebar", "notice", "form", "comments"):
            if self.r.random() < (0 if self.opaque else 0.08):  # without names nothing would tell
                out.insert(self.r.randint(1, len(out)), self.junk(kind))
        return "\n".join(out) if self.r.random() < 0.5 else "".join(out)

    def table(self) -> str:
        width, rows, head = self.r.randint(1, 4), self.r.randint(1, 4), self.r.random()
        row = lambda tag: "<tr>" + "".join(f"<{tag}>{MARK}{self.words(1, 5)}</{tag}>" for _ in range(width)) + "</tr>"
        first = row("th") if head < 0.6 else ""
        return "<table>" + (f"<thead>{first}</thead><tbody>" if head < 0.25 else first) + "".join(row("td") for _ in range(rows)) + "</table>"

    def junk(self, kind: str) -> str:
        tag = self.r.choice(_TAGS[kind])
        if self.opaque and tag not in ("form", "ul"):
            tag = "div"
        attr = self.attr(kind) if tag in ("div", "ul", "ol", "section", "p", "ins", "form") or self.r.random() < 0.5 else ""
        if tag == "form" and self.r.random() < 0.5:
            attr = ""
        cued = 1 if not attr and tag in ("div", "section", "p", "ul", "ol") or self.opaque else 0.35  # without a name only words tell
        say = lambda: " ".join(self.r.sample(_CUES[kind], self.r.choice((1, 1, 2)))) + " " if self.r.random() < cued else ""
        items = []
        for _ in range(self.r.choice((1, 1, 2, 4, 6) if kind != "ad" else (1, 1, 2))):
            if kind == "nav" or kind in ("sidebar", "footer", "header") and self.r.random() < 0.4:
                link = f'<a href="/{self.word()}">{say()}{self.words(1, 3)}</a>'
                items.append(f"<li>{link}</li>" if self.r.random() < 0.7 else link + " ")
            elif kind == "form":
                items.append(f"<label>{say()}{self.words(1, 3)}</label><input name=q><button>{say()}{self.words(1, 2)}</button>")
            elif kind == "comments":
                body = f"<p>{say()}{self.paragraph()}</p>"
                items.append(self.r.choice((body, f"<h4>{self.words(1, 2)}</h4>{body}", f'<div class="comment"><span>{self.words(1, 2)}</span>{body}</div>', f"<li>{say()}{self.words(2, 40)}</li>", f"<article class='comment'>{body}</article>")))
            else:
                text = say() + (self.words(1, 20) if self.r.random() < 0.7 else self.paragraph())
                if tag == "p":  # which holds no blocks: they would close it
                    items.append(text + " ")
                    continue
                items.append(self.r.choice((f"<p>{text}</p>", text + " ", f"<h3>{self.words(1, 4)}</h3><p>{text}</p>", f"<div>{text}</div>")))
        if kind == "footer" and self.r.random() < 0.2:
            items = [self.r.choice(("© ", "&copy; ", "Copyright ")) + self.words(1, 3)]
        inner = "".join(items)
        if tag not in ("ul", "ol") and "<li>" in inner:
            inner = f"<ul>{inner}</ul>"
        return f"<{tag}{attr}>{inner}</{tag}>"

    def small(self) -> str:
        """A page of little but text: bare text, one block, a few paragraphs; or of nothing but something else."""
        r = self.r
        if r.random() < 0.2:
            html = self.junk(r.choice(("nav", "footer", "form", "notice")))
        else:
            html = r.choice((
                lambda: MARK + self.paragraph(),
                lambda: f"<div{self.attr('plain')}>{MARK}{self.paragraph()}</div>",
                lambda: "".join(f"<p>{MARK}{self.paragraph()}</p>" for _ in range(r.randint(1, 4))),
                lambda: f"<article>{self.main()}</article>",
                lambda: f"<div>{self.main()}</div>",
                lambda: f"<h1>{MARK}{self.words(1, 6)}</h1><p>{MARK}{self.paragraph()}</p>",
                self.table,
            ))()
            if r.random() < 0.25:
                html += self.junk("footer")
        return html if r.random() < 0.4 else f"<html><head><title>{self.words(1, 8)}</title></head><body>{html}</body></html>" if r.random() < 0.7 else f"<html><body>{html}</body></html>"

    def page(self) -> str:
        r = self.r
        self.opaque = r.random() < 0.15
        if r.random() < 0.12:
            return self.small()
        body = []
        order = [k for k in ("notice", "header", "nav", "ad", "form") if r.random() < (0.75 if k == "nav" else 0.5 if k == "ad" else 0.4)]
        r.shuffle(order)
        body += [self.junk(k) for k in order]
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td")) if not self.opaque else "div"
        attr = self.attr("main") if tag in ("div", "section", "td") or r.random() < 0.3 else ""
        bare = r.random() < 0.07
        main = self.main() if bare else f"<{tag}{attr}>{self.main()}</{tag}>"
        if tag == "td" and not bare:
            main = f"<table><tr>{main}</tr></table>"
        for _ in range(0 if bare else r.choice((0, 0, 1, 2)) if r.random() < 0.95 else r.randint(3, 30)):
            main = f"<{(w := r.choice(('div', 'main', 'section')))}{self.attr('plain') if w != 'main' else ''}>{main}</{w}>"
        body.append(main)
        if r.random() < 0.3:
            body.insert(r.randint(0, len(body)), self.junk("sidebar"))
        after = [k for k in ("sidebar", "comments", "ad", "form", "notice", "nav") if r.random() < 0.3]
        r.shuffle(after)
        body += [self.junk(k) for k in after]
        if r.random() < 0.8:
            body.append(self.junk("footer"))
        if r.random() < 0.4:
            body = [f"<div{self.attr('plain')}>", *body, "</div>"]
        html = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{r.choice(('', chr(10))).join(body)}</body></html>"
        return html[: -r.randint(1, len(html) // 3)] if r.random() < 0.08 else html


def labelled(html: str) -> tuple[list, np.ndarray]:
    found = blocks(html)
    y = np.array([MARK in t for _, t, _ in found], np.float32)
    return [(p, t.replace(MARK, "") or "x", n) for p, t, n in found], y


_TRAINED: list = []  # the weights of this process


def trained(spark: SparkSession | None = None) -> dict[str, np.ndarray]:
    """The weights, trained once in a process, and with a session once for its shared folder and the code of this module."""
    if not _TRAINED:
        _TRAINED.append(_kept(spark) if spark else train())
    return _TRAINED[0]


def _kept(spark: SparkSession) -> dict[str, np.ndarray]:
    """The weights in the shared folder. They are written beside and renamed, so nobody reads a part of them."""
    source = inspect.getsource(sys.modules[__name__])
    place = f"{shared_dir(spark)}/html-weights-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(place)):
        made = train()
        beside = f"{place}-{uuid.uuid4().hex}"
        rows = [(name, list(v.shape), v.tobytes()) for name, v in made.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.parquet(beside)
        if files.exists(path(place)) or not files.rename(path(beside), path(place)):
            files.delete(path(beside), True)
        return made
    return {r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in spark.read.parquet(place).collect()}


def train() -> dict[str, np.ndarray]:
    """Adam on the training pages, in an order fixed by the seed; the mean of the weights of the last epochs."""
    maker, rng = PageMaker(SEED), np.random.default_rng(SEED)
    data = []
    while len(data) < PAGES:
        found, y = labelled(maker.page())
        if found:
            data.append((features(found), y))
    w = start_weights(rng)
    mean, steps = {k: np.zeros(v.shape) for k, v in w.items()}, 0
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = np.argsort([len(y) for _, y in data] + rng.uniform(0, 4, len(data)))  # pages of like length together
        for at in rng.permutation(np.arange(0, len(order), BATCH)):
            part = [data[k] for k in order[at : at + BATCH]]
            x, live = pad([f for f, _ in part])
            y = np.zeros(live.shape, np.float32)
            for k, (_, labels) in enumerate(part):
                y[: len(labels), k] = labels
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for name, g in gradients(w, x, live, y).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if epoch >= EPOCHS - MEAN:
                steps += 1
                for name in w:
                    mean[name] += w[name]
    return {name: (v / steps).astype(np.float32) for name, v in mean.items()}


def page_gates(w: dict[str, np.ndarray], found: list[tuple[int, str, int]]) -> dict[str, np.ndarray]:
    """Gate inputs of the blocks of a page: those of each distinct path are made once."""
    paths: dict[int, int] = {}
    at = np.array([paths.setdefault(p, len(paths)) for p, _, _ in found])
    distinct, texts = list(paths), text_features(found)
    out = {}
    for d in "fb":
        of_path = np.concatenate([path_features(distinct[k : k + 1024]) @ w[f"x{d}"][: PATH + STEPS] for k in range(0, len(distinct), 1024)])
        out[d] = of_path[at] + texts @ w[f"x{d}"][PATH + STEPS :] + w[f"c{d}"]
    return out


def main_texts(w: dict[str, np.ndarray], pages: list[str], masks: dict | None = None) -> list[str]:
    masks = {} if masks is None else masks
    found = [blocks(p, masks) for p in pages]
    order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
    out = [""] * len(pages)
    while order:  # the longest pages first, few at a time, so that padding stays small
        longest = len(found[order[-1]])
        part = [order.pop() for _ in range(min(len(order), 64, max(1, CELLS // longest)))]
        live = np.zeros((longest, len(part)), bool)
        gates = {d: np.zeros((longest, len(part), 4 * HIDDEN), np.float32) for d in "fb"}
        for column, k in enumerate(part):
            live[: len(found[k]), column] = True
            for d, g in page_gates(w, found[k]).items():
                gates[d][: len(g), column] = g
        p, _, _ = _forward(w, gates, live)
        for column, k in enumerate(part):
            out[k] = " ".join(t for (_, t, _), keep in zip(found[k], p[:, column] >= 0.5, strict=False) if keep)
            found[k] = []
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    lean(spark)
    shared = spark.sparkContext.broadcast(weights or trained(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict = {}
        for batch in small(batches, 256):
            texts = main_texts(shared.value, [h or "" for h in batch["html"].to_pylist()], masks)
            yield records(_RESULT, [batch["page_id"], batch["url"], texts, [len(t) for t in texts]])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
