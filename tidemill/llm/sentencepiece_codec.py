"""SentencePiece encoding and decoding by a max-plus scan over the piece lattice.

Method: the encoding is a path through the lattice of all pieces that match the text. The model merges pieces by rank, and
a sequence of pieces is what its merging gives just when every two neighbours are: if the merging of both together leaves
them as they are. So a step from one piece to the next weighs 0 where the two may be neighbours and minus infinity where
they may not, and the path of largest weight is the only one of weight 0. Ids equal those of the library. Whether two
pieces may be neighbours is read off their merge histories, back from the whole pieces to single characters. A character
no piece covers becomes its bytes. Between a blank and what comes before it, and around line ends, no piece crosses:
segments there are solved once for all their occurrences in a batch, all distinct segments in step, in numpy.

Giant documents are split into chunks of 65536 code points, which spread over the tasks. The state at a chunk's border is
the piece that starts before the border and ends at or beyond it. Each chunk yields a max-plus transfer matrix between its
entry and exit states. The matrices of a document are multiplied in a tree, FAN at a time in one task, level by level;
going down the tree again gives every chunk its entry and exit state, and the chunks are backtraced independently.

The vocabulary is read by the driver from a .model file (a parameter) and broadcast; 32000 pieces take a few MB. Only
merge-type models with the identity normaliser and byte fallback are taken, whose pieces all come from merges of falling
score. Decoding gives every text back exactly; a literal U+2581 is encoded by its bytes for that, where the library would
take it for a blank.

Edge cases: null and empty texts have no ids and decode to ''. Rows with equal ids stay apart, equal texts have equal ids.
An empty table gives an empty result. encode() keeps all other columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, mix64, records, small
from .lookup import Lookup

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
FAN = 64
SHORT = 64  # characters of a segment that is solved in step with others
SPACE, LITERAL = "▁", "\ud800"  # the literal sign stands in as a lone surrogate, which no text holds
ALONE = "\n\t\r\v\f"
LOW = np.float32(-1e30)


class Vocabulary(NamedTuple):
    steps: Lookup  # (beginning of a piece, next character) -> longer beginning
    ids: np.ndarray  # of each beginning, -1 where it is no piece
    rank: np.ndarray  # of the last merge of each piece, -1 for single characters
    left: np.ndarray  # what was merged last
    right: np.ndarray
    pairs: Lookup  # (piece, piece) -> number of the merge
    merged: np.ndarray  # rank of each merge
    bytes_: list[int]
    longest: int
    texts: list[bytes]
    alone: str
    segment: str


def packed(v: Vocabulary) -> tuple:
    """The vocabulary as a broadcast holds it."""
    return tuple(v._replace(steps=v.steps.state, pairs=v.pairs.state))


def unpacked(shared) -> Vocabulary:
    v = Vocabulary(*shared.value)
    return v._replace(steps=Lookup.of(*v.steps), pairs=Lookup.of(*v.pairs))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def merge(text: str, rank: dict[str, float]) -> tuple[list[str], list[tuple[float, str, str]]]:
    """The textbook merge loop, for single pieces: what is left, and all merges as (rank, left, right)."""
    parts, done = list(text), []
    while True:
        found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        if not found:
            return parts, done
        r, k = min(found)
        done.append((r, parts[k], parts[k + 1]))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rule = model.normalizer_spec
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not model.trainer_spec.byte_fallback or model.trainer_spec.model_type != 2:
        raise ValueError("only merge models with the identity normaliser, byte fallback and a dummy prefix are supported")
    if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
    id_of = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
    if any(SPACE in p.lstrip(SPACE) for p in rank) or any(c not in rank for p in rank for c in p):
        raise ValueError("pieces that hold a blank inside, or a character that is no piece, are not supported")
    size = len(model.pieces)
    level, left, right = np.full(size, -1.0), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for p, k in id_of.items():
        if len(p) > 1:
            parts, done = merge(p, rank)
            ranks = [r for r, _, _ in done]
            if parts != [p] or ranks != sorted(ranks):
                raise ValueError(f"{p!r} does not come from merges in order")
            level[k], left[k], right[k] = ranks[-1], id_of[done[-1][1]], id_of[done[-1][2]]
    both = [(id_of[p[:n]] * size + id_of[p[n:]], r) for p, r in rank.items() for n in range(1, len(p)) if p[:n] in rank and p[n:] in rank]

    number = {"": 0}
    for p in rank:
        for n in range(1, len(p) + 1):
            number.setdefault(p[:n], len(number))
    keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in number if p], np.uint64)
    of_byte = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 6}
    texts = [b""] * size
    for p, k in id_of.items():
        texts[k] = p.replace(SPACE, " ").encode()
    for b in range(256):
        texts[of_byte[f"<0x{b:02X}>"]] = bytes([b])
    used = {c for p in rank if len(p) > 1 for c in p}
    alone = "".join(c for c in ALONE if c not in used)
    segment = f"[{alone}]|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
    ids = np.array([id_of.get(p, -1) for p in number], np.int64)
    pairs = np.array([k for k, _ in both], np.uint64)
    return Vocabulary(Lookup(mix64(keys)), ids, level, left, right, Lookup(mix64(pairs)), np.array([r for _, r in both]), [of_byte[f"<0x{b:02X}>"] for b in range(256)], max(map(len, rank)), texts, alone, segment)


def escape(text: str) -> str:
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


def neighbours(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether merging both pieces together leaves them as they are; -1 stands for anything that never merges.

    Both merge histories are walked back from the end, the later merge first. The two parts at the border in between would
    merge if their common rank came before the next merge of either; of equal ranks the one further left comes first.
    """
    ok = np.ones(len(left), bool)
    live = np.flatnonzero((left >= 0) & (right >= 0))
    x, y = left[live], right[live]
    next_x = next_y = np.full(len(live), np.inf)
    size, ranks = np.int64(len(v.rank)), np.append(v.merged, np.inf)
    while len(live):
        joint = ranks[v.pairs(mix64((x * size + y).astype(np.uint64)))]
        bad = (joint < next_x) & (joint <= next_y)
        ok[live[bad]] = False
        rank_x, rank_y = v.rank[x], v.rank[y]
        go = ~bad & ((rank_x >= 0) | (rank_y >= 0))
        live, x, y, next_x, next_y, rank_x, rank_y = (z[go] for z in (live, x, y, next_x, next_y, rank_x, rank_y))
        of_y = rank_y >= rank_x
        next_x, next_y = np.where(of_y, next_x, rank_x), np.where(of_y, rank_y, next_y)
        x, y = np.where(of_y, x, v.right[x]), np.where(of_y, v.left[y], y)
    return ok


def _matches(v: Vocabulary, code: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in the text: start, length and id (-1 for a character without a piece); room: characters up to the
    segment's end."""
    at, node, out = np.arange(len(code)), np.zeros(len(code), np.int64), []
    for n in range(1, v.longest + 1):
        keep = room[at] >= n
        at, node = at[keep], node[keep]
        if not len(at):
            break
        found = v.steps(mix64(node.astype(np.uint64) << np.uint64(21) | code[at + (n - 1)].astype(np.uint64)))
        known = found >= 0
        if n == 1:
            lone = at[~known]
            out.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1, np.int64)))
        at, node = at[known], found[known] + 1  # number 0 is the empty beginning
        whole = v.ids[node] >= 0
        out.append((at[whole], np.full(int(whole.sum()), n, np.int64), v.ids[node[whole]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _to_bytes(v: Vocabulary, c: int) -> list[int]:
    return [v.bytes_[b] for b in (SPACE if chr(c) == LITERAL else chr(c)).encode()]


def _spelled(v: Vocabulary, token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens below 0 are characters (-1 - code) and become their bytes."""
    bare = np.flatnonzero(token < 0)
    if not len(bare):
        return token, owner
    as_bytes = {t: _to_bytes(v, -1 - t) for t in set(token[bare].tolist())}
    lists = [as_bytes[t] for t in token[bare].tolist()]
    copies = np.ones(len(token), np.int64)
    copies[bare] = [len(x) for x in lists]
    owner, wide = np.repeat(owner, copies), np.repeat(token, copies)
    wide[wide < 0] = [b for x in lists for b in x]
    return wide, owner


class Recent:
    """neighbours() of a vocabulary, with the answers last found for many pairs at hand."""

    def __init__(self, v: Vocabulary, bits: int = 17):
        self.v, self.shift = v, np.uint64(64 - bits)
        self.keys, self.answers = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ok = np.ones(len(left), bool)
        live = np.flatnonzero((left | right) >= 0)
        x, y = left[live], right[live]
        key = x * len(self.v.rank) + y
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)
        ok[live] = self.answers[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            ok[live[new]] = found = neighbours(self.v, x[new], y[new])
            self.keys[slot[new]] = key[new]
            self.answers[slot[new]] = found
        return ok


def encode_segments(v: Vocabulary, segments: list[str], pairs: Recent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments in a row, and how many of each segment; all are solved in step."""
    pairs = pairs or Recent(v)
    sizes = np.array([len(s) for s in segments], np.int64)
    code = _codes("".join(segments))
    first = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(segments)), sizes)
    start, length, ids = _matches(v, code, first[1:][owner] - np.arange(len(code)))
    offset = start - first[owner[start]]
    order = np.argsort(offset.astype(np.uint16) if sizes.max(initial=0) < 1 << 16 else offset, kind="stable")  # all pieces at the first character of their segment, then at the second, ...
    begin, length, ids = (start + owner[start])[order], length[order], ids[order]
    goal, steps_at = begin + length, np.cumsum(np.bincount(offset)) if len(offset) else np.zeros(0, np.int64)
    node = first[:-1] + np.arange(len(segments))  # one node more than characters
    back, token_at = np.zeros(len(code) + len(segments), np.int64), np.full(len(code) + len(segments), -1, np.int64)
    lo = 0
    for hi in steps_at.tolist():  # every beginning of a segment has one encoding, so one last piece
        good = np.flatnonzero(pairs(token_at[begin[lo:hi]], ids[lo:hi])) + lo
        back[goal[good]], token_at[goal[good]] = length[good], ids[good]
        lo = hi
    at, live, steps = sizes.copy(), np.flatnonzero(sizes > 0), []
    while len(live):
        end = node[live] + at[live]
        at[live] -= back[end]
        found = token_at[end]
        steps.append((live, np.where(found >= 0, found, -1 - code[first[live] + at[live]].astype(np.int64))))
        live = live[at[live] > 0]
    owner = np.concatenate([s[0] for s in steps[::-1]]) if steps else np.zeros(0, np.int64)
    token = np.concatenate([s[1] for s in steps[::-1]]) if steps else np.zeros(0, np.int64)
    by_owner = np.argsort(owner.astype(np.uint16) if len(segments) < 1 << 16 else owner, kind="stable")
    token, owner = _spelled(v, token[by_owner], owner[by_owner])
    return token, np.bincount(owner, minlength=len(segments))


class _Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes whole texts and keeps the ids of the segments it has solved, up to `most` of them."""

    def __init__(self, v: Vocabulary, most: int = 500_000):
        self.v, self.most, self.find, self.pairs, self.recent = v, most, re.compile(v.segment).findall, Pairs(v), Recent(v)
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _solve(self, segments: list[str]) -> None:
        solved, n = encode_segments(self.v, [s if len(s) <= SHORT else "" for s in segments], self.recent)
        parts, at = [], 0
        if any(len(s) > SHORT for s in segments):
            ends = np.cumsum(n)
            for k, s in enumerate(segments):
                if len(s) > SHORT:
                    ids = walk(self.pairs, s)
                    parts += [solved[at : ends[k]], ids]
                    at, n[k] = ends[k], len(ids)
            solved = np.concatenate([*parts, solved[at:]])
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(n) - n)
        self.sizes = np.append(self.sizes, n)
        self.flat = np.append(self.flat, solved.astype(np.int32))

    def __call__(self, escaped: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most or len(self.flat) > 4 * self.most:
            self.forget()
        known, before = self.known, len(self.known)
        places = []
        for t in escaped:
            words = self.find(t)
            places.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if len(known) > before:
            self._solve(list(islice(known, before, None)))
        out = []
        for p in places:
            n = self.sizes[p]
            out.append(self.flat[np.repeat(self.starts[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out


def encode_texts(v: Vocabulary, escaped: list[str]) -> list[np.ndarray]:
    return Encoder(v)(escaped)


def decode_ids(v: Vocabulary, ids) -> str:
    return b"".join(map(v.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


# ---- long segments and chunks of giant texts -----------------------------------------------------------------------


class Pairs(dict):
    """Whether two pieces may be neighbours, found once; forgets everything when it is full."""

    def __init__(self, v: Vocabulary, most: int = 300_000):
        super().__init__()
        self.v, self.most, self.width = v, most, len(v.rank)

    def __missing__(self, key: int) -> bool:
        if len(self) > self.most:
            self.clear()
        a, b = divmod(key, self.width)
        self[key] = found = bool(neighbours(self.v, np.array([a]), np.array([b]))[0])
        return found

    def fill(self, at: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Finds all pairs of pieces that meet in a text, given by start, at once."""
        count = np.bincount(at, minlength=int((at + length).max()) + 2 if len(at) else 1)
        first = np.cumsum(count) - count
        n = count[at + length]
        left = np.repeat(np.arange(len(at)), n)
        right = first[(at + length)[left]] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        a, b = ids[left], ids[right]
        keys = np.unique((a * self.width + b)[(a >= 0) & (b >= 0)])
        keys = keys[np.fromiter((k not in self for k in keys.tolist()), bool, len(keys))]
        if len(self) + len(keys) > self.most:
            self.clear()
        self.update(zip(keys.tolist(), neighbours(self.v, keys // self.width, keys % self.width).tolist(), strict=True))


def _by_start(v: Vocabulary, code: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, length, ids = _matches(v, code, room)
    order = np.lexsort((length, start))
    return start[order], length[order], ids[order]


def spread(pairs: Pairs, edges: tuple, lo: int, hi: int, entries: list[tuple[int, int]]) -> tuple[dict, dict]:
    """From entries (place, last piece) through all pieces that start in [lo, hi): (start, length, piece) of those that end
    at hi or beyond with the entries that reach them as bits, and (place, piece) -> the (place, piece) before it."""
    reach: dict[int, dict[int, int]] = {}
    for k, (at, token) in enumerate(entries):
        reach.setdefault(at, {})[token] = reach.get(at, {}).get(token, 0) | 1 << k
    exits, back = {}, {}
    a, b = np.searchsorted(edges[0], (lo, hi))
    part = [x[a:b] for x in edges]
    for s in range(0, len(part[0]), 50_000):
        pairs.fill(*[x[s : s + 50_000 + 64] for x in part])
    width = pairs.width
    here, now = None, -1
    for at, n, token in zip(*[x.tolist() for x in part], strict=True):
        if at != now:
            here, now = reach.pop(at, None), at
        if here is None:
            continue
        bits = 0
        for before, mask in here.items():
            if before < 0 or token < 0 or pairs[before * width + token]:
                bits |= mask
                back[at + n, token] = at, before
        if bits:
            if at + n >= hi:
                exits[at, n, token] = bits
            else:
                to = reach.setdefault(at + n, {})
                to[token] = to.get(token, 0) | bits
    return exits, back


def _follow(v: Vocabulary, code: np.ndarray, back: dict, at: int, token: int, until: tuple[int, int]) -> np.ndarray:
    out = []
    while (at, token) != until:
        before = back[at, token]
        out.append(token if token >= 0 else -1 - int(code[before[0]]))
        at, token = before
    ids = np.array(out[::-1], np.int64)
    return _spelled(v, ids, ids)[0]


def walk(pairs: Pairs, segment: str) -> np.ndarray:
    """The ids of one long segment."""
    code = _codes(segment)
    exits, back = spread(pairs, _by_start(pairs.v, code, len(code) - np.arange(len(code))), 0, len(code), [(0, -1)])
    (_, _, token), = exits
    return _follow(pairs.v, code, back, len(code), token, (0, -1))


class Chunk:
    """A chunk [lo, hi) of a window of text with what comes before and after it; states are pieces over its borders."""

    def __init__(self, pairs: Pairs, window: str, lo: int, hi: int, first: bool, last: bool):
        v = pairs.v
        self.pairs, self.window, self.lo, self.hi, self.code = pairs, window, lo, hi, _codes(window)
        blank, alone = self.code == ord(SPACE), np.isin(self.code, [ord(c) for c in v.alone])
        edge = np.ones(len(self.code) + 1, bool)  # no piece crosses such a place
        edge[1:-1] = blank[1:] & ~blank[:-1] | alone[1:] | alone[:-1]
        self.edges_at = np.flatnonzero(edge)
        room = self.edges_at[np.searchsorted(self.edges_at, np.arange(len(self.code)), "right")] - np.arange(len(self.code))
        self.edges = _by_start(v, self.code, room)
        self.entries = [(lo, -1)] if first else [(a + n, t) for a, n, t in self._over(lo)]
        self.exits = None if last else self._over(hi)

    def _over(self, border: int) -> list[tuple[int, int, int]]:
        a, b = np.searchsorted(self.edges[0], (border - self.pairs.v.longest, border))
        return [(s, n, t) for s, n, t in zip(*[x[a:b].tolist() for x in self.edges], strict=True) if s + n >= border]

    def _inner(self) -> tuple[int, int] | None:
        """The first place in the chunk that no piece crosses, and the last one before its end."""
        inside = self.edges_at[np.searchsorted(self.edges_at, self.lo) : np.searchsorted(self.edges_at, self.hi)]
        return (int(inside[0]), int(inside[-1])) if len(inside) else None

    def _from_entries(self, entries: list, hi: int) -> tuple[dict, dict]:
        exits, back = spread(self.pairs, self.edges, self.lo, hi, entries)
        return exits, back

    def transfer(self) -> np.ndarray:
        inner = self._inner()
        own = self.exits
        if inner is None:
            exits, _ = self._from_entries(self.entries, self.hi)
            spanning = {k: (at, t) for k, (at, t) in enumerate(self.entries) if at >= self.hi}
            masks = [exits.get(y, 0) | sum(1 << k for k, (at, t) in spanning.items() if at == y[0] + y[1] and t == y[2] and y[0] < self.lo) for y in own] if own is not None else [sum({1 << k for k in range(len(self.entries)) if any(m >> k & 1 for m in exits.values()) or k in spanning})]
        else:
            head, _ = self._from_entries(self.entries, inner[0])
            alive = 0
            for m in head.values():
                alive |= m
            for k, (at, _) in enumerate(self.entries):
                alive |= (at >= inner[0]) << k
            tail, _ = spread(self.pairs, self.edges, inner[1], self.hi, [(inner[1], -1)])
            masks = [alive if y in tail else 0 for y in own] if own is not None else [alive]
        out = np.full((len(self.entries), len(masks)), LOW, np.float32)
        for j, m in enumerate(masks):
            for k in range(len(self.entries)):
                if m >> k & 1:
                    out[k, j] = 0
        return out

    def trace(self, enter: int, leave: int) -> np.ndarray:
        """Ids of the pieces that start in the chunk."""
        v, inner, entry = self.pairs.v, self._inner(), self.entries[enter]

        def last(exits: dict, back: dict, start: tuple[int, int]) -> np.ndarray:
            found = self.exits[leave] if self.exits is not None else next(iter(exits), None)
            return _follow(v, self.code, back, found[0] + found[1], found[2], start) if found in exits else np.zeros(0, np.int64)

        if inner is None:
            return last(*self._from_entries([entry], self.hi), entry)
        head, back = self._from_entries([entry], inner[0])
        parts = [_follow(v, self.code, back, a + n, t, entry) for a, n, t in head]
        middle = re.findall(v.segment, self.window[inner[0] : inner[1]])
        encoder = Encoder(v)
        encoder.pairs = self.pairs
        for k in range(0, len(middle), 20_000):
            parts += encoder(["".join(middle[k : k + 20_000])])
        tail, back = spread(self.pairs, self.edges, inner[1], self.hi, [(inner[1], -1)])
        return np.concatenate([*parts, last(tail, back, (inner[1], -1))])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), LOW)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    while len(matrices) > 1:
        matrices = [combine(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def states(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """Entry and exit state of each matrix on the best path between two states."""
    ahead = [matrices[0][enter]]
    for m in matrices[1:]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        before = int((ahead[k - 1] + matrices[k][:, leave]).argmax()) if k else enter
        out.append((before, leave))
        leave = before
    return out[::-1]


# ---- DataFrames ----------------------------------------------------------------------------------------------------


def _chunk_of(pairs: Pairs, chunk: int, count: int, part: str) -> Chunk:
    """A chunk row: the chunk with up to `longest` characters before and after it; the first one gets the dummy prefix."""
    before = 0 if chunk == 0 else pairs.v.longest
    text = (SPACE if chunk == 0 else "") + escape(part)
    hi = before + CHUNK + (chunk == 0)
    return Chunk(pairs, text, before, min(hi, len(text)), chunk == 0, chunk == count - 1)


def _pack(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int32).tobytes() + m.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float32, offset=8).reshape(np.frombuffer(b, np.int32, 2))


def _giant_ids(big: DataFrame, shared) -> DataFrame:
    """row_id, ids of the giant texts of big (_row, text)."""
    longest, size = unpacked(shared).longest, CHUNK

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("chunk", pa.int32()), ("count", pa.int32()), ("part", pa.string())])
        for batch in small(batches, 1):
            row, text = batch["_row"][0].as_py(), batch["text"][0].as_py()
            count = -(-len(text) // size)
            for k in range(count):
                yield records(schema, [[row], [k], [count], [text[max(0, k * size - longest) : (k + 1) * size + longest]]])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("node", pa.int32()), ("matrix", pa.binary())])
        pairs = Pairs(unpacked(shared))
        for batch in small(batches, 1):
            row = batch.to_pylist()[0]
            yield records(schema, [[row["row_id"]], [row["chunk"]], [_pack(_chunk_of(pairs, row["chunk"], row["count"], row["part"]).transfer())]])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("node", pa.int32()), ("matrix", pa.binary())])
        for batch in small(batches, 8):
            whole = [_pack(product([_unpack(x["matrix"]) for x in sorted(group, key=lambda x: x["node"])])) for group in batch["group"].to_pylist()]
            yield records(schema, [batch["row_id"], batch["parent"], whole])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("node", pa.int32()), ("enter", pa.int32()), ("leave", pa.int32())])
        for batch in small(batches, 8):
            for row in batch.to_pylist():
                group = sorted(row["group"], key=lambda x: x["node"])
                found = states([_unpack(x["matrix"]) for x in group], row["enter"], row["leave"])
                yield records(schema, [[row["row_id"]] * len(found), [x["node"] for x in group], [a for a, _ in found], [b for _, b in found]])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))])
        pairs = Pairs(unpacked(shared))
        for batch in small(batches, 1):
            row = batch.to_pylist()[0]
            found = _chunk_of(pairs, row["chunk"], row["count"], row["part"]).trace(row["enter"], row["leave"])
            yield records(schema, [[row["row_id"]], [row["chunk"]], pa.array([found.astype(np.int32)], pa.list_(pa.int32()))])

    chunks = cut(big.select("_row", "text").mapInArrow(split, "row_id long, chunk int, count int, part string").repartition("row_id", "chunk"), "chunks")
    level = cut(chunks.mapInArrow(transfers, "row_id long, node int, matrix binary"), "transfers")
    groups, most = [], chunks.agg(F.max("count")).first()[0] or 1
    while most > 1 or not groups:
        group = level.groupBy("row_id", F.expr(f"node div {FAN}").cast("int").alias("parent")).agg(F.collect_list(F.struct("node", "matrix")).alias("group"))
        groups.append(group)
        level = cut(group.mapInArrow(up, "row_id long, node int, matrix binary"), "transfers")
        most = -(-most // FAN)
    steps = level.select("row_id", "node", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
    for group in reversed(groups):
        steps = group.join(steps.withColumnRenamed("node", "parent"), ["row_id", "parent"]).mapInArrow(down, "row_id long, node int, enter int, leave int")
    parts = chunks.join(steps.withColumnRenamed("node", "chunk"), ["row_id", "chunk"]).mapInArrow(back, "row_id long, chunk int, ids array<int>")
    return parts.groupBy("row_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_CHECKED = [T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]


def _lists(ids: pa.Array) -> Iterator[list[int]]:
    ends = ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else np.zeros(1, np.int64)
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield flat[a:b].tolist()


def _checks(v: Vocabulary, texts: list, ids) -> list[pa.Array]:
    decoded = [decode_ids(v, x) for x in ids]
    exact = [d == (t or "") for d, t in zip(decoded, texts, strict=True)]
    return [pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()), pa.array(exact, pa.bool_())]


def _coded(docs: DataFrame, model: str, keep: list[str], checked: bool) -> DataFrame:
    """The columns keep of docs, ids, and, if checked, decoded_sha256 and exact, all in one step over the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(load(model)))
    fields = [docs.schema[c] for c in keep]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = unpacked(shared)
        encoder = Encoder(v)
        for batch in small(batches, 200):
            texts = batch["text"].to_pylist()
            ids = encoder([SPACE + escape(t) if t else "" for t in texts])
            made = _checks(v, texts, (x.tolist() for x in ids)) if checked else []
            names = [*keep, "ids", *(["decoded_sha256", "exact"] if checked else [])]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(ids, pa.list_(pa.int32())), *made], names=names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = unpacked(shared)
        for batch in small(batches, 1):
            made = _checks(v, batch["text"].to_pylist(), _lists(batch["ids"]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], batch["ids"], *made], names=[*keep, "ids", "decoded_sha256", "exact"])

    giant = F.coalesce(F.length("text"), F.lit(0)) > CHUNK
    short = docs.where(~giant).mapInArrow(whole, T.StructType([*fields, _IDS, *(_CHECKED if checked else [])]))
    big = cut(docs.where(giant).withColumn("_row", F.monotonically_increasing_id()), "giants")
    found = _giant_ids(big, shared)
    long = big.join(found, big["_row"] == found["row_id"]).select(*[c for c in dict.fromkeys([*keep, "text"])], "ids")
    return short.unionByName(long.mapInArrow(check, T.StructType([*fields, _IDS, *_CHECKED])) if checked else long.select(*keep, "ids"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with ids: array<int> of its text column, in place of any column of that name."""
    docs = docs.drop("ids", "_row", "row_id")
    return _coded(docs, model, docs.columns, False)


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """coded with decoded: the text of its ids column ('' for null), in place of any column of that name."""
    coded = coded.drop("decoded")
    shared = coded.sparkSession.sparkContext.broadcast(packed(load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = unpacked(shared)
        for batch in small(batches):
            texts = [decode_ids(v, x) for x in _lists(batch["ids"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))


def encoded_and_checked(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The columns keep of docs, ids, decoded_sha256 and exact (the ids decode to the text) of every row."""
    return _coded(docs.select(*dict.fromkeys([*keep, "text"])), model, list(keep), True)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    out = encoded_and_checked(docs, ("doc_id", "n_chars"))
    return out.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_sha256", "exact")
