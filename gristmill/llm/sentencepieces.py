"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

Some texts at a time are cut into units at places no piece crosses (before a run of spaces, around line feeds), and the
units not yet known are concatenated. The suffixes of that text are sorted by as many characters as the longest piece
has; every piece finds its occurrences as one range by binary search; the occurrences are the edges of each unit's
lattice, sorted by end, and are relaxed from left to right. In a BPE model an edge may follow the last piece of the text
before it if and only if merging the two pieces' text alone gives just these two; exactly one edge then reaches each
place, and the path to the end is the encoding that merging by scores gives. Characters in no piece become bytes.

Units with runs of spaces or of the space mark itself (whose pieces have tied scores) are merged by a heap instead.
Decoding looks pieces' bytes up and takes the leading space away; it gives back every text without U+2581 exactly.

Null texts have null ids; empty texts none. Repeated rows are encoded each; extra columns are ignored; an empty table
gives no rows. No text is cut: a long one is a step of its own, and a unit of n characters takes time in proportion to n
(n log n where it is merged by a heap).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import _power_tables, Chunk, chunks, mix

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text matched at a time, and units remembered between these (some 50 bytes each).
STEP_BYTES, REMEMBER = 1 << 19, 1_000_000
RESULT = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


class Model:
    """Pieces, their ranks (place in the order of merging), and which pairs of pieces merge to which."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(size)]
        self.size = size
        self.bytes_at = {int(m.id_to_piece(i)[3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.piece = [m.id_to_piece(i) for i in range(size)]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        score = np.array([m.get_score(i) for i in range(size)])
        #: Characters that only occur within pieces, as symbols of their own after the pieces.
        extra = sorted({c for p in self.id for c in p} - set(self.id))
        self.id |= {c: size + i for i, c in enumerate(extra)}
        self.text = dict(map(reversed, self.id.items()))
        n = size + len(extra)
        values = np.unique(-score)
        self.rank = np.full(n, -1, np.int64)
        real = [i for p, i in self.id.items() if len(p) > 1]
        self.rank[real] = np.searchsorted(values, -score[real])
        tied = np.bincount(self.rank[real], minlength=len(values) + 1) > 1
        self.tied = np.zeros(n, bool)
        self.tied[real] = tied[self.rank[real]]
        self.n = n
        left, right, whole = [], [], []
        for i in real:
            p = self.text[i]
            for k in range(1, len(p)):
                if (a := self.id.get(p[:k])) is not None and (b := self.id.get(p[k:])) is not None:
                    left.append(a), right.append(b), whole.append(i)
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        o = np.argsort(key)
        self.pair_key, self.pair_rank = key[o], self.rank[np.array(whole, np.int64)[o]]
        self.pair_of: dict[int, int] | None = None
        self.asked, self.answer = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        # The last merge that makes each piece; pieces that merging does not give back as one are never used.
        self.first, self.second = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.usable = np.zeros(n, bool)
        for p, i in self.id.items():
            if len(p) == 1:
                self.usable[i] = True
            else:
                parts, last = self.merge(p)
                self.usable[i] = len(parts) == 1
                if len(parts) == 1:
                    self.first[i], self.second[i] = last
        self.breaks_at_lines = not any("\n" in p for p in self.id)
        pieces = sorted((p for p, i in self.id.items() if self.usable[i] and i < size or len(p) == 1))
        self.chars = np.array(sorted({ord(c) for p in self.id for c in p}), np.uint32)
        self.longest = max(map(len, pieces))
        self.pieces = np.array([self.id[p] for p in pieces], np.int64)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        spelled = [self.coded(np.frombuffer(p.encode("utf-32-le"), np.uint32)).astype(">u2").tobytes() for p in pieces]
        self.low = np.array(spelled, f"S{2 * self.longest}")
        self.high = np.array([x + b"\xff" * (2 * self.longest - len(x)) for x in spelled], f"S{2 * self.longest}")
        self.width = np.append([len(self.text.get(i, "?")) for i in range(n)], 1)
        out = [(self.piece[i].replace(MARK, " ").encode() if not special[i] else bytes([int(self.piece[i][3:5], 16)]) if m.is_byte(i) else b"") for i in range(size)]
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_begin = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def coded(self, code_points: np.ndarray) -> np.ndarray:
        """Small numbers for the characters of pieces, 65000 for others."""
        at = np.minimum(np.searchsorted(self.chars, code_points), len(self.chars) - 1)
        return np.where(self.chars[at] == code_points, at + 1, 65000)

    def merge(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Merge by score, leftmost first among equals: (symbols, the last merge). Characters in no piece are -code point.

        Neighbours wait in a heap by (rank, place); a symbol is known by its place and end.
        """
        n, last = len(text), (-1, -1)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins at a place
        waiting: list[tuple[int, int, int, int]] = []

        def meet(i: int) -> None:
            if i >= 0 and end[i] < n:
                w = self.id.get(text[i : end[end[i]]])
                if w is not None and w < self.size:
                    heapq.heappush(waiting, (int(self.rank[w]), i, end[i], end[end[i]]))

        for i in range(n - 1):
            meet(i)
        while waiting:
            _, i, j, k = heapq.heappop(waiting)
            if end[i] == j and j < n and end[j] == k:
                last = (self.id[text[i:j]], self.id[text[j:k]])
                end[i], end[j] = k, -1
                if k < n:
                    before[k] = i
                meet(before[i])
                meet(i)
        parts, i = [], 0
        while i < n:
            parts.append(text[i : end[i]])
            i = end[i]
        return [self.id.get(p, -ord(p[0])) for p in parts], last

    def ids(self, symbols: list[int], text_of: dict[int, str]) -> list[int]:
        out = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                out += [self.bytes_at[b] for b in text_of[s].encode("utf-8", "surrogatepass")]
        return out

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the text of pieces a and b merges to just a and b; answers are remembered, each at one place that its key names."""
        key = a * self.n + b
        at = (mix(key.astype(np.uint64)) & np.uint64(len(self.asked) - 1)).astype(np.int64)
        out = self.answer[at]
        new = np.flatnonzero(self.asked[at] != key)
        if len(new):
            k, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            got = self.find_may_follow(a[first], b[first])
            out[new] = got[which]
            self.asked[at[first]], self.answer[at[first]] = k, got  # of two keys with one place the last stays, in both
        return out

    def follows(self, a: int, b: int) -> bool:
        """``find_may_follow`` of one pair."""
        if self.pair_of is None:
            self.pair_of = dict(zip(self.pair_key.tolist(), self.pair_rank.tolist()))
            self.lists = self.rank.tolist(), self.first.tolist(), self.second.tolist()
        (rank, first, second), limit = self.lists, 1 << 62
        while True:
            if self.pair_of.get(a * self.n + b, limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, second[a]
            else:
                limit, b = rb + 1, first[b]

    def find_may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later merge at the border, again and again, and look for one across it that would have come before."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max - 1)
        while len(live):
            bad = self.merged_rank(a, b) < limit
            good[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            keep = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[keep], a[keep], b[keep], ra[keep], rb[keep]
            in_a = ra > rb
            limit = np.where(in_a, ra, rb + 1)
            a, b = np.where(in_a, self.second[a], a), np.where(in_a, b, self.first[b])
        return good


def match(m: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, piece) of every occurrence of a piece in ``text`` (coded characters, 0 between units)."""
    n, d = len(text), m.longest
    padded = np.zeros(n + d, ">u2")
    padded[:n] = text
    rows = np.lib.stride_tricks.sliding_window_view(padded, d)[:n]
    live = np.flatnonzero((text > 0) & (text < 65000))
    rows = np.ascontiguousarray(rows[live])
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0  # nothing beyond the unit
    keys = rows.view(f"S{2 * d}").ravel()
    suffix = np.argsort(keys, kind="stable")
    keys = keys[suffix]
    lo, hi = np.searchsorted(keys, m.low, "left"), np.searchsorted(keys, m.high, "right")
    count = hi - lo
    piece = np.repeat(np.arange(len(m.pieces)), count)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return live[suffix[at]], m.piece_len[piece], m.pieces[piece]


#: Edges that end after as many characters of their units; from here on they are relaxed together.
TOGETHER = 24


def relax(m: Model, where: np.ndarray, end: np.ndarray, piece: np.ndarray, step: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """The piece that ends each place's prefix of its unit (-1: none); edges in order of step, end and falling length."""
    cut = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]]))
    last = np.full(n, -1, np.int64)
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        w, e, p = where[x:y], end[x:y], piece[x:y]
        if y - x < TOGETHER:  # the rest of some long units
            for at, to, now in zip(w.tolist(), e.tolist(), p.tolist()):
                if last[to - 1] >= 0:
                    continue
                if not (ok := bool(begins[at])) and (prior := int(last[at - 1])) >= 0:
                    ok = prior == m.n or now == m.n or m.follows(prior, now)
                if ok:
                    last[to - 1] = now
            continue
        fresh, before = begins[w], last[np.maximum(w - 1, 0)]
        ok = fresh | (before == m.n) | ((p == m.n) & (before >= 0))
        check = np.flatnonzero(~ok & (before >= 0))
        ok[check] = m.may_follow(before[check], p[check])
        last[e[ok][::-1] - 1] = p[ok][::-1]
    return last


def encode_units(m: Model, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each unit, all ids) of units of ``size`` code points, each followed by one that is not part of it."""
    begin = np.cumsum(size + 1) - size - 1
    unit = np.repeat(np.arange(len(size)), size + 1)
    inside = np.ones(len(points), bool)
    inside[begin + size] = False
    mark = (points == ord(MARK)) & inside
    leading = (size > 0) & mark[begin]
    slow = np.bincount(unit, mark, minlength=len(size)) > leading  # runs of marks: their merges tie
    code = m.coded(points)
    code[~inside | slow[unit]] = 0
    where, length, piece = match(m, code)
    # Characters in no piece are edges of their own, with a symbol that joins with nothing.
    lost = np.flatnonzero(code == 65000)
    where, length, piece = np.concatenate([where, lost]), np.concatenate([length, np.ones(len(lost), np.int64)]), np.concatenate([piece, np.full(len(lost), m.n)])
    end = where + length
    step = end - begin[unit[where]]
    bits = [int(x).bit_length() for x in (len(points) + 1, m.longest)]
    o = np.argsort((((step << bits[0]) | end) << bits[1]) | (m.longest - length))
    begins = np.zeros(len(points) + 1, bool)
    begins[begin] = True
    last = relax(m, where[o], end[o], piece[o], step[o], begins, len(points) + 1)
    # Walk back from each unit's end, all units at once.
    at = begin + size
    alive = np.flatnonzero(~slow & (size > 0))
    back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(alive):
        p = last[at[alive] - 1]
        if (bad := p < 0).any():  # not to be met; merging one by one is always right
            slow[alive[bad]] = True
            alive, p = alive[~bad], p[~bad]
        at[alive] -= m.width[p]
        back.append((alive, p, at[alive]))
        alive = alive[at[alive] > begin[alive]]
    none = np.zeros(0, np.int64)
    u, p, w = (np.concatenate([none, *(b[k] for b in back)]) for k in range(3))
    apart = [(none, none, none)]
    for i in np.flatnonzero(slow).tolist():
        text = points[begin[i] : begin[i] + size[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        symbols = np.array([m.n if x < 0 else x for x in m.merge(text)[0]], np.int64)
        apart.append((np.full(len(symbols), i), symbols, begin[i] + np.cumsum(m.width[symbols]) - m.width[symbols]))
    u, p, w = (np.concatenate([x[~slow[u]], *(b[k] for b in apart)]) for k, x in enumerate((u, p, w)))
    o = np.argsort(w)
    u, p, w = u[o], p[o], w[o]
    if (lone := np.flatnonzero(p >= m.size)).size:  # to bytes
        spelled = [[m.bytes_at[b] for b in chr(x).encode("utf-8", "surrogatepass")] for x in points[w[lone]].tolist()]
        reps = np.ones(len(p), np.int64)
        reps[lone] = [len(x) for x in spelled]
        begin_at = np.cumsum(reps) - reps
        u, p = np.repeat(u, reps), np.repeat(p, reps)
        for i, x in zip(begin_at[lone].tolist(), spelled):
            p[i : i + len(x)] = x
    return np.bincount(u, minlength=len(size)), p


class Encoder:
    """Encodes and decodes chunks, remembering units: those of long ago and those of late, each in order of hash."""

    def __init__(self, m: Model):
        self.m = m
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.old = self.late = (none.astype(np.uint64), none, none)  # hashes, place of the ids, number of ids
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def units(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first byte, end byte, hash, whether it begins a text) of each unit."""
        b = c.data
        own = np.zeros(len(b), bool)
        own[c.end - 1] = True  # the space after each text is not part of it
        starts = np.zeros(len(b) + 1, bool)
        space = b == 32
        spelled = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x96) & (b[2:] == 0x81)) if len(b) > 2 else np.zeros(0, np.int64)  # the mark itself
        space[spelled] = True
        starts[1:-1] = space[1:] & ~space[:-1]
        starts[spelled[space[spelled - 1] & (spelled > 0)]] = False
        after = spelled[spelled + 3 < len(b)] + 3
        starts[after] &= ~space[after]
        if self.m.breaks_at_lines:
            starts[:-1] |= b == 10
            starts[1:] |= b == 10
        starts[c.begin] = True
        starts[c.end - 1] = True
        s = np.flatnonzero(starts[:-1])
        e = np.append(s[1:], len(b))
        keep = ~own[s]
        s, e = s[keep], e[keep]
        e -= own[e - 1]
        power, inverse = _power_tables(len(b) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])])
        first = np.zeros(len(b) + 1, bool)
        first[c.begin] = True
        h = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + first[s] * np.uint64(0xD1B54A32D192ED03))
        return np.searchsorted(c.end, s, side="right"), s, e, h, first[s]

    def find(self, known: tuple[np.ndarray, np.ndarray, np.ndarray], u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether known, place in ``known``)."""
        if not len(known[0]):
            return np.zeros(len(u), bool), np.zeros(len(u), np.int64)
        at = np.minimum(np.searchsorted(known[0], u), len(known[0]) - 1)
        return known[0][at] == u, at

    def learn(self, c: Chunk, u: np.ndarray, s: np.ndarray, e: np.ndarray, begins: np.ndarray) -> None:
        """Encode units (hashes in order, bytes, whether at the begin of a text) that are not known."""
        # Their bytes, with a space before those that begin a text and a line feed after each.
        n = e - s + begins + 1
        at = np.cumsum(n) - n
        data = np.full(int(n.sum()), 10, np.uint8)
        data[at[begins]] = 32
        size = e - s
        data[np.arange(int(size.sum())) + np.repeat(at + begins - (np.cumsum(size) - size), size)] = c.data[np.arange(int(size.sum())) + np.repeat(s - (np.cumsum(size) - size), size)]
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        points[points == 32] = ord(MARK)
        count, ids = encode_units(self.m, points, heads[at + n] - heads[at] - 1)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), len(self.flat)), np.int32)])
        place = self.used + np.cumsum(count) - count
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.late = self.joined(self.late, (u, place, count))
        if 8 * len(self.late[0]) > len(self.old[0]):
            self.old, self.late = self.joined(self.old, self.late), (u[:0], place[:0], count[:0])

    @staticmethod
    def joined(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b))

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        doc, s, e, h, begins = self.units(c)
        u, first, at = np.unique(h, return_index=True, return_inverse=True)
        new = ~(self.find(self.old, u)[0] | self.find(self.late, u)[0])
        if new.any():
            if len(self.old[0]) + len(self.late[0]) > REMEMBER:
                self.forget()
                new[:] = True
            x = first[new]
            self.learn(c, u[new], s[x], e[x], begins[x])
        place, count = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        for known in (self.old, self.late):
            ok, where = self.find(known, u)
            place[ok], count[ok] = known[1][where[ok]], known[2][where[ok]]
        place, count = place[at], count[at]
        total = np.bincount(doc, count, minlength=len(c.rows)).astype(np.int64)
        index = np.arange(int(count.sum())) + np.repeat(place - (np.cumsum(count) - count), count)
        return total, self.flat[index]

    def decode(self, ids: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each text, all bytes)."""
        size = self.m.out_size[ids]
        out = self.m.out[np.arange(int(size.sum())) + np.repeat(self.m.out_begin[ids] - (np.cumsum(size) - size), size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        cut = np.concatenate([[0], np.cumsum(total)])
        begin, end = ends[cut[:-1]], ends[cut[1:]]
        keep = np.ones(len(out), bool)
        lead = begin[(end > begin)]
        lead = lead[out[lead] == 32]
        keep[lead] = False
        n = end - begin
        n[np.isin(begin, lead) & (end > begin)] -= 1
        return n, out[keep]


def mended(m: Model, texts: pa.Array, rows: np.ndarray, total: np.ndarray, flat: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of each text, all ids, whether they decode to it), with texts that didn't come back encoded anew, each by itself.

    Units are remembered by 64 bits; one that is taken for another shows here. Texts with the space mark don't come back anyway.
    """
    parts, total, same = np.split(flat, np.cumsum(total)[:-1]), total.copy(), same.copy()
    for i in np.flatnonzero(~same).tolist():
        text = texts.slice(int(rows[i]), 1)
        if text.null_count or MARK in text[0].as_py():
            continue
        own, [c] = Encoder(m), chunks(text)
        count, parts[i] = own.encode(c)
        _, back = own.decode(parts[i], count)
        total[i], same[i] = count[0], back.tobytes() == text[0].as_py().encode()
    return total, np.concatenate(parts), same


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model))  # as large as the model's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker's tasks share what one has learnt: ids of a unit are the same for all.
        coder = shared.value.coder = getattr(shared.value, "coder", None) or Encoder(shared.value)
        for b in batches:
            texts = b.column("text")
            ids, valid = b.column("doc_id"), texts.is_valid().to_numpy(zero_copy_only=False)
            for c in chunks(texts, STEP_BYTES):
                total, flat = coder.encode(c)
                n, back = coder.decode(flat, total)
                body = np.ones(len(c.data), bool)
                body[c.end - 1] = False
                source, size = c.data[body], c.end - c.begin - 1
                if len(source) == len(back) and (n == size).all():
                    sums = np.concatenate([[0], np.cumsum(source != back)])
                    cut = np.concatenate([[0], np.cumsum(size)])
                    same = sums[cut[1:]] == sums[cut[:-1]]
                else:
                    x, y = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(n)])
                    same = np.array([np.array_equal(source[x[i] : x[i + 1]], back[y[i] : y[i + 1]]) for i in range(len(size))], bool)
                ok = valid[c.rows]
                if not same.all():
                    total, flat, same = mended(shared.value, texts, c.rows, total, flat, same)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total)]), pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(~ok))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c.rows)), pa.array(total, pa.int64(), mask=~ok), lists, pa.array(same, pa.bool_(), mask=~ok)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def query(docs: DataFrame) -> DataFrame:
    return encode(docs)
