"""Secret scan by assignment-aware lexing.

Three base patterns are always reported. Beyond them, source and configuration syntax is lexed from left to right into
name-literal pairs: a name (bare, quoted, in brackets, dotted, with a type) before ``=``, ``:``, ``:=`` or ``=>``, and
what stands behind: quoted, triple-quoted and back-quoted strings, bare values, pieces joined by ``+``, here-documents and
indented blocks (``name: |``); values end at comments. Elements ``<name>value</name>`` and PEM blocks are pairs too. A
name bound to a value is a constant; a later pair that refers to it passes its own sensitivity on to the constant's
literals, through chains. A literal is reported if the most sensitive name that reaches it and the literal itself score
enough together, unless one base span holds all of it.

Names and values are looked for around operators alone, each character is read a bounded number of times, and constants
are nodes of a graph that is walked once, so work grows in proportion to the text. Within a bare value that holds
operators (``a=b=c``) the first pair has the whole value, later ones what lies up to the next operator's name.

Spans are code points, end exclusive; an assign span is the whole match. Null texts are empty; an empty table gives no
rows; repeated rows are scanned each; extra columns pass through ``redact``. Each text is scanned whole, in one task.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run is one match of [0-9a-f]+

#: Weights of the parts of a target's name.
NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "pw": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "creds": 0.9,
    "bearer": 0.9, "auth": 0.6, "authorization": 0.8, "private": 0.5, "key": 0.45, "signing": 0.4, "encryption": 0.4, "access": 0.3, "client": 0.2, "session": 0.3, "salt": 0.6, "cookie": 0.5, "dsn": 0.5, "pin": 0.4,
}
NOT_SECRET = re.compile(r"(?i)^(?:x+|\*+|\.+|null|none|true|false|nil|undefined|changeme|example.*|your[_-].*|test|dummy|redacted|placeholder.*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*|https?://[^:@]*)$")
THRESHOLD = 0.5

_OPERATOR = re.compile(r"=>|:=|[:=]")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+", re.A)
_TYPE = re.compile(r"[ \t]*+[A-Za-z_][\w.]*+[ \t]*+=(?![=>])", re.A)
_SPACES = re.compile(r"[ \t]*+")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]+&][^\s"'`,;(){}\[\]&]*+""")
_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}") for q in "\"'"} | {"`": re.compile(r"`(?:[^`\\]|\\.)*+`", re.S)}
_HERE = re.compile(r"""(?:\$\([ \t]*+cat[ \t]++)?<<[-~]?[ \t]*+["']?([A-Za-z_]\w*+)["']?""", re.A)
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*+(?:#[^\n]*+)?\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)>([^<>\n]++)</", re.A)
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]++)-----")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a name is; scores of names of usual length are remembered."""
    return _name_score(name) if len(name) < 200 else _name_score.__wrapped__(name)


@lru_cache(10_000)
def _name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if "api" in parts and "key" in parts:
        return 1.0
    return min(1.0, sum(NAME_WEIGHT.get(p, 0.0) for p in set(parts)))


def literal_score(s: str, quoted: bool) -> float:
    """0 for placeholders and short or plain words, up to 1 for long mixed text."""
    if len(s) < 6 or NOT_SECRET.match(s) or " " in s.strip() and not quoted:
        return 0.0
    n = len(s)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    kinds = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    if not quoted and (kinds < 2 or not re.search("[0-9]", s)):
        return 0.0
    return min(1.0, entropy / 3.0) * (1.0 if kinds >= 2 else 0.7)


class Lexer:
    """Pairs of one text: (names of the target, literal spans with whether quoted, names referred to), by place."""

    def __init__(self, text: str):
        self.text = text
        self.bare_end = 0  # up to here lies a bare value that was taken
        self.body_end = 0  # up to here lies a value of several lines; it is lexed too, but no other begins in it
        self.open: dict[str, int] = {}  # up to here a kind of quote has no partner
        self.lines: dict[str, list[int]] | None = None

    def name_before(self, at: int, least: int) -> tuple[int, str] | None:
        """(begin, name) of what ends before ``at``: an identifier, in quotes or not, with or without a closing bracket."""
        t, i = self.text, at
        while i > least and t[i - 1] in " \t":
            i -= 1
        if i > least and t[i - 1] == "]":
            i -= 1
        quote = t[i - 1] if i > least and t[i - 1] in "\"'`" else ""
        i -= len(quote)
        end = i
        while i > least and (t[i - 1].isascii() and t[i - 1].isalnum() or t[i - 1] in "_$.-"):
            i -= 1
        if quote and (i <= 0 or t[i - 1] != quote):
            return None
        while i < end and not (t[i].isalpha() or t[i] in "_$"):  # 2x.y-z: from a letter on
            i += 1
        m = _IDENT.match(t, i, end)
        while m and m.end() < end:  # a.-b: what follows the last odd mark
            i = m.end() + 1
            while i < end and not (t[i].isalpha() or t[i] in "_$"):
                i += 1
            m = _IDENT.match(t, i, end)
        return (i, m[0]) if m else None

    def string(self, at: int) -> tuple[int, int, int] | None:
        """(begin, end, place after) of the string whose quote is at ``at``; None if it has no partner."""
        t, q = self.text, self.text[at]
        if t.startswith(q * 3, at) and at >= max(self.body_end, self.open.get(q * 3, 0)):
            end = t.find(q * 3, at + 3)
            if end >= 0:
                return at + 3, end, end + 3
            self.open[q * 3] = len(t)
        if at < max(self.open.get(q, 0), self.body_end if q == "`" else 0):
            return None
        if m := _STRING[q].match(t, at):
            return at + 1, m.end() - 1, m.end()
        line = t.find("\n", at) if q != "`" else -1
        self.open[q] = line if line >= 0 else len(t)  # the rest of the line's quotes of this kind stand alone
        return None

    def here(self, word: str, at: int) -> tuple[int, int] | None:
        """The lines from the next one on up to one that is ``word``."""
        if self.lines is None:
            self.lines, place = {}, 0
            for line in self.text.split("\n"):
                self.lines.setdefault(line.strip(" \t\r"), []).append(place)
                place += len(line) + 1
        begin = self.text.find("\n", at) + 1
        ends = self.lines.get(word, [])
        i = bisect_left(ends, begin)
        return (begin, max(begin, ends[i] - 1)) if begin and i < len(ends) else None

    def block(self, name: int, at: int) -> tuple[int, int]:
        """The lines from ``at`` on that are indented deeper than the name's."""
        t, line = self.text, self.text.rfind("\n", 0, name) + 1
        depth = _SPACES.match(t, line).end() - line
        begin = end = at
        while at < len(t):
            stop = t.find("\n", at)
            stop = len(t) if stop < 0 else stop
            inside = _SPACES.match(t, at, stop).end()
            if inside < stop:
                if inside - at <= depth:
                    break
                begin = inside if end == begin else begin
                end = stop
            at = stop + 1
        return begin, end

    def value(self, at: int, name: int) -> tuple[list[tuple[int, int, bool]], list[str], int]:
        """(literals, names referred to, place after) of what stands behind an operator; place 0: lex on in it."""
        t, literals, names = self.text, [], []
        at = _SPACES.match(t, at).end()
        if at >= self.body_end:
            body = None
            if m := _HERE.match(t, at):
                body = self.here(m[1], m.end())
            elif m := _BLOCK.match(t, at):
                body = self.block(name, m.end())
            if body and body[1] > body[0]:
                self.body_end = body[1]
                return [(*body, True)], [], 0
        after = 0
        while at < len(t):
            i = at
            while i < min(len(t), at + 2) and t[i] in "rbfuRBFU":
                i += 1
            i = i if i < len(t) and t[i] in "\"'`" else at
            if t[i] in "\"'`":
                if not (s := self.string(i)):
                    break
                literals.append((s[0], s[1], True))
                at = after = s[2]
                if t.find("\n", s[0], s[1]) >= 0:
                    self.body_end, after = s[1], 0
            elif t[at] == "#" or t.startswith(("//", "/*"), at) or not (m := _BARE.match(t, at)):
                break
            else:
                end = m.end() - (len(m[0]) - len(m[0].rstrip("+")))
                self.bare_end = m.end()
                literals.append((at, end, False))
                if _IDENT.fullmatch(t, at, end):
                    names.append(t[at:end])
                at, after = end, 0
            i = _SPACES.match(t, at).end()
            if not t.startswith("+", i):
                break
            at = _SPACES.match(t, i + 1).end()
        return literals, names, after

    def pairs(self) -> Iterator[tuple[str, list[tuple[int, int, bool]], list[str]]]:
        t, least, after = self.text, 0, 0
        typed: tuple[int, tuple[int, str]] | None = None  # where the value of a name with a type begins
        inner: tuple[str, int, int] | None = None  # a pair within a bare value, and where that ends

        def close(end: int) -> Iterator[tuple[str, list[tuple[int, int, bool]], list[str]]]:
            if inner is not None and end > inner[1]:
                yield inner[0], [(inner[1], end, False)], [t[inner[1] : end]] if _IDENT.fullmatch(t, inner[1], end) else []

        for m in _OPERATOR.finditer(t):
            a, z = m.span()
            if a < after or m[0] in "=:" and (t[z : z + 1] == m[0] or a and t[a - 1] in "=!<>:"):
                continue
            name = typed[1] if typed and typed[0] == a else self.name_before(a, max(least, after))
            least, within = z, a < self.bare_end
            if inner is not None and (name or not within):
                yield from close(name[0] if name and within else inner[2])
                inner = None
            if name is None:
                continue
            if m[0] == ":" and (kind := _TYPE.match(t, z)):
                typed = (kind.end() - 1, name)
            elif within:
                inner = (name[1], z, self.bare_end)
            else:
                literals, names, after_it = self.value(z, name[0])
                after = max(after, after_it)
                if literals:
                    yield name[1], literals, names
        if inner is not None:
            yield from close(inner[2])
        if "</" in t:
            for m in _ELEMENT.finditer(t):
                yield m[1], [(*m.span(2), True)], []
        if "-----BEGIN " in t:
            at = 0
            for m in _PEM.finditer(t):
                if m.start() >= at:
                    if (end := t.find("-----END ", m.end())) < 0:
                        break
                    stop = t.find("-----", end + 9)
                    at = stop + 5 if stop >= 0 else len(t)
                    yield m[1], [(m.start(), at, True)], []


def literal_spans(text: str) -> list[tuple[int, int]]:
    constants: dict[str, int] = {}
    nodes: list[tuple[list[tuple[int, int, bool]], list[int]]] = []  # literals, and earlier nodes referred to
    best: list[float] = []
    for name, literals, names in Lexer(text).pairs():
        known = {n: x for n in names if (x := constants.get(n, constants.get(n.rpartition(".")[2]))) is not None}
        nodes.append(([x for x in literals if x[2] or text[x[0] : x[1]] not in known], list(known.values())))
        constants[name] = constants[name.rpartition(".")[2]] = len(best)
        best.append(name_score(name))
    found: dict[tuple[int, int, bool], float] = {}
    for i in range(len(nodes) - 1, -1, -1):  # a node is referred to by later ones only
        if best[i] > 0:
            for x in nodes[i][1]:
                best[x] = max(best[x], best[i])
            for x in nodes[i][0]:
                found[x] = max(found.get(x, 0.0), best[i])
    return sorted({(a, b) for (a, b, q), s in found.items() if s >= THRESHOLD and s * literal_score(text[a:b], q) >= THRESHOLD})


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    if ":" in text or "=" in text or "</" in text or "-----BEGIN " in text:
        out.sort()
        starts, ends = [x for x, _, _ in out], list(accumulate((y for _, y, _ in out), max))
        out += [(a, b, "literal") for a, b in literal_spans(text) if not ((i := bisect_right(starts, a)) and ends[i - 1] >= b)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by kind, the digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                found = spans(t.as_py() or "")
                base = [x for x in found if x[2] != "literal"]
                rows.append(([sum(x[2] == k for x in found) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            *counts, literals = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), literals], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's span replaced by ``mark`` (overlapping spans as one) and n_chars, if there, brought up to date."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lengths = b.column("text").to_pylist(), b.column("n_chars").to_pylist() if "n_chars" in names else []
            for i, t in enumerate(texts):
                if t and (found := spans(t)):
                    parts, at = [], 0
                    for x, y, _ in found:
                        if x >= at:
                            parts += [t[at:x], mark]
                        at = max(at, y)
                    texts[i] = "".join(parts) + t[at:]
                    if lengths:
                        lengths[i] = len(texts[i])
            new = {"text": pa.array(texts, b.schema.field("text").type)} | ({"n_chars": pa.array(lengths, b.schema.field("n_chars").type)} if lengths else {})
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in names], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
