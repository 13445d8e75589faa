"""Toxicity: a gap-weighted subsequence kernel machine with Nystroem landmarks, over sentences.

Words are compared by their common subsequences of three letters, each worth ``DECAY ** (span in one + span in the
other)``, spans under ``SPAN`` letters; the kernel is normalised, values under ``CUT`` are set to 0 and the rest raised to
``POWER``. Letters put in only lengthen spans; marks between letters are left out, look-alike digits are read as letters, and
single letters set apart by spaces are one word, so gapped and spelled-out insults stay near their plain form. A sentence's kernel is the sum over its words.

Landmarks are words picked from the training rows: those that tell toxic documents best, spread out, and the ordinary
words nearest to them. Sentences are mapped by the Nystroem features of the landmarks; those of harmless documents are
negative; in a toxic document the sentence that now scores highest is positive (a few rounds). The linear hinge-loss
model over these is folded into one weight per landmark. A document scores by its worst sentence, through a logistic
curve fitted on training documents.

At most ``MAX_ROWS`` labelled rows outside the held-out part, of at most ``MAX_BYTES`` bytes each and ``TOTAL_BYTES`` in
all, are fitted on (stated bounds), in one task; every whole text is scored. Nulls and empty texts score as a document
without words. Repeated rows are scored each, and count once in the fit; labels other than 0 and 1 are not used; without
both classes all scores are the share of label 1, or 0.5. Empty table: no rows. Extra columns are ignored. Very long texts
are a step of their own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Chunk, chunks, held_out, labelled_sample
from gristmill.llm.quality_classifier import logistic

MAX_ROWS, MAX_BYTES, TOTAL_BYTES = 6000, 200_000, 32 << 20
DECAY, SPAN, CUT, POWER = 0.8, 7, 0.4, 3
LANDMARKS, ORDINARY, ROUNDS, HARD, COST = 40, 16, 4, 8000, 1.0
CODES = 1 << 15
#: Words whose values a task remembers (16 bytes each).
REMEMBER = 2_000_000
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]

_LETTER = np.zeros(256, np.uint16)
_LETTER[65:91] = _LETTER[97:123] = np.arange(1, 27)
for _digit, _like in zip(b"013457@$!", b"oieastasi"):
    _LETTER[_digit] = _like - 96
_LETTER[128:192] = 27 + np.arange(64) % 5  # the last byte of other letters; their first is left out


class Words:
    """Some words as one run of letter codes; other marks are left out."""

    def __init__(self, data: np.ndarray, s: np.ndarray, e: np.ndarray):
        size = e - s
        self.n = len(s)
        self.word = np.repeat(np.arange(self.n), size)
        self.code = _LETTER[data[np.arange(len(self.word)) + np.repeat(s - (np.cumsum(size) - size), size)]]
        self.word, self.code = self.word[self.code > 0], self.code[self.code > 0]

    def triples(self, of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(word, triple, weight) for each pair of gaps."""
        word, code = (self.word, self.code) if of is None else (self.word[of[self.word]], self.code[of[self.word]])
        for a, b in GAPS:
            d = a + b
            if d >= len(code):
                continue
            at = np.flatnonzero(word[:-d] == word[d:])
            yield word[at], (code[at] << np.uint16(10)) | (code[at + a] << np.uint16(5)) | code[at + d], DECAY ** (d + 1)

    def profiles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, triple, weight) with one weight for each word and triple, normalised by word."""
        parts = [(w.astype(np.int64) * CODES + c, np.full(len(w), x)) for w, c, x in self.triples()]
        key = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.int64)
        key, at = np.unique(key, return_inverse=True)
        weight = np.bincount(at, np.concatenate([x for _, x in parts]) if parts else None, minlength=len(key))
        word = key // CODES
        norm = np.sqrt(np.bincount(word, weight**2, minlength=self.n))
        return word, key % CODES, weight / norm[word]


class Landmarks:
    def __init__(self, words: list[bytes]):
        self.words = words
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        word, code, weight = Words(data, end - [len(w) for w in words], end).profiles()
        self.table = np.zeros((CODES, len(words)), np.float32)
        self.table[code, word] = weight
        self.most = self.table.max(1)

    def kernels(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words that come near a landmark, their sharpened kernel values)."""
        bound, square = np.zeros(w.n), np.zeros(w.n)
        for word, code, x in w.triples():
            bound += x * np.bincount(word, self.most[code], minlength=w.n)
            square += x * x * np.bincount(word, minlength=w.n)  # at most the square of the norm
        near = bound >= CUT * np.sqrt(square)
        near &= square > 0
        if not near.any():
            return np.zeros(0, np.int64), np.zeros((0, len(self.words)))
        ids = np.flatnonzero(near)
        place = np.cumsum(near) - 1
        parts = [(place[word] * CODES + code, np.full(len(word), x)) for word, code, x in w.triples(near)]
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        weight = np.bincount(at, np.concatenate([x for _, x in parts]))
        word, code = key // CODES, key % CODES
        norm = np.sqrt(np.bincount(word, weight**2, minlength=len(ids)))
        begin = np.searchsorted(word, np.arange(len(ids) + 1))
        k = np.zeros((len(ids), len(self.words)), np.float32)
        for x in range(0, len(ids), 1000):  # some words' table rows at a time
            y = min(x + 1000, len(ids))
            part = slice(begin[x], begin[y])
            k[x:y] = np.add.reduceat(self.table[code[part]] * weight[part, None].astype(np.float32), begin[x:y] - begin[x], axis=0)
        k /= norm[:, None]
        return ids, np.where(k >= CUT, k, 0) ** POWER


def kernels_of(words: list[bytes], marks: Landmarks, step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks.kernels of any number of words, some at a time."""
    ids, values = [np.zeros(0, np.int64)], [np.zeros((0, len(marks.words)))]
    for a in range(0, len(words), step):
        part = words[a : a + step]
        end = np.cumsum([len(w) for w in part])
        i, k = marks.kernels(Words(np.frombuffer(b"".join(part), np.uint8), end - [len(w) for w in part], end))
        some = k.any(axis=1)
        ids.append(i[some] + a)
        values.append(k[some])
    return np.concatenate(ids), np.concatenate(values)


def sentence_words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence, first byte, end byte, hash) of each word; single letters in a row are one word."""
    doc, s, e, h = c.words()
    if len(s) > 1:
        single = e - s == 1
        join = np.concatenate([[False], single[1:] & single[:-1] & (s[1:] == e[:-1] + 1) & (c.data[e[:-1]] == 32) & (doc[1:] == doc[:-1])])
        head = np.flatnonzero(~join)
        last = np.append(head[1:], len(s)) - 1
        merged = last > head
        h = h[head] + np.where(merged, np.add.reduceat(h * np.arange(1, len(h) + 1, dtype=np.uint64), head), np.uint64(0))
        doc, s, e = doc[head], s[head], e[last]
    lines = np.concatenate([[0], np.cumsum(c.data == 10)])
    stop = np.isin(c.data[e - 1], np.frombuffer(b".!?", np.uint8))
    fresh = np.concatenate([[True], stop[:-1] | (doc[1:] != doc[:-1]) | (lines[s[1:]] != lines[e[:-1]])]) if len(s) else np.zeros(0, bool)
    return doc, np.cumsum(fresh) - 1, s, e, h


class Values:
    """Each word's part of a margin, by hash; those met before are remembered, up to ``REMEMBER``."""

    def __init__(self, marks: Landmarks, weight: np.ndarray):
        self.marks, self.weight = marks, weight
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, c: Chunk, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        u, first, at = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, u)
        old = np.zeros(len(u), bool)
        if len(self.known):
            old = self.known[np.minimum(place, len(self.known) - 1)] == u
        value = np.zeros(len(u))
        value[old] = self.value[place[old]]
        x = first[~old]
        ids, k = self.marks.kernels(Words(c.data, s[x], e[x]))
        fresh = np.zeros(len(x))
        fresh[ids] = k @ self.weight
        value[~old] = fresh
        if len(self.known) > REMEMBER:
            self.known, self.value = u, value
        else:
            self.known, self.value = np.insert(self.known, place[~old], u[~old]), np.insert(self.value, place[~old], fresh)
        return value[at]


def document_margins(c: Chunk, values: Values) -> np.ndarray:
    """The largest sum over a sentence's words, for each document (0 where no word is near a landmark)."""
    doc, sent, s, e, h = sentence_words(c)
    out = np.zeros(len(c.rows))
    if not len(s):
        return out
    value = values.of(c, h, s, e)
    use = np.flatnonzero(value)
    total = np.bincount(sent[use], value[use], minlength=sent[-1] + 1)
    owner = doc[np.flatnonzero(np.concatenate([[True], sent[1:] != sent[:-1]]))]
    best = np.full(len(c.rows), -np.inf)
    np.maximum.at(best, owner, total)
    return np.where(np.isfinite(best), best, 0.0)


def support_vectors(x: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2/2 + sum of squared hinge losses, by Newton's steps over the support vectors.

    Rows count ``times``, and both classes alike in sum.
    """
    a = np.hstack([x, np.ones((len(x), 1))])
    c = cost * times * np.where(y > 0, times.sum() / (2 * max(1, times[y > 0].sum())), times.sum() / (2 * max(1, times[y < 0].sum())))
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    loss = lambda w: w @ ridge @ w / 2 + (c * np.maximum(0, 1 - y * (a @ w)) ** 2).sum()
    w, now = np.zeros(a.shape[1]), None
    for _ in range(60):
        s = np.flatnonzero(y * (a @ w) < 1)
        g = ridge @ w - 2 * a[s].T @ (c[s] * (y[s] - a[s] @ w))
        step = np.linalg.solve(ridge + 2 * (a[s].T * c[s]) @ a[s], g)
        now = loss(w) if now is None else now
        size = 1.0
        while size > 1e-6 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-9 * max(1.0, now):
            break
        w, now = w - size * step, then
    return w


def fit(texts: list[str], y: np.ndarray) -> tuple[list[bytes], np.ndarray, float, float] | float:
    """(landmark words, weight of each, slope, offset), or a constant score."""
    if len(set(y.tolist())) < 2:
        return float((y > 0).mean()) if len(y) else 0.5
    doc, sent, words, hashes = [], [], [], []
    known: dict[int, bytes] = {}
    base = 0
    for c in chunks(pa.array(texts, pa.string())):
        d, t, s, e, h = sentence_words(c)
        u, first = np.unique(h, return_index=True)
        for x, i in zip(u.tolist(), first.tolist()):
            if x not in known:
                known[x] = c.data[s[i] : e[i]].tobytes().lower().strip(b".,;:!?\"'()")
        doc.append(c.rows[d])
        sent.append(t + base)
        hashes.append(h)
        base += (int(t[-1]) + 1) if len(t) else 0
    doc, sent, hashes = np.concatenate(doc), np.concatenate(sent), np.concatenate(hashes)
    u = np.unique(hashes)
    spelled = [known[x] for x in u.tolist()]
    place = {w: i for i, w in enumerate(sorted(set(spelled)))}
    words = list(place)
    word = np.array([place[w] for w in spelled], np.int64)[np.searchsorted(u, hashes)]
    # How much a word tells: log odds of its document frequencies, shrunk, times the share of toxic documents with it.
    pair = np.unique(doc * len(words) + word)
    toxic, n1, n0 = y[pair // len(words)] > 0, (y > 0).sum(), (y < 0).sum()
    df1, df0 = (np.bincount(pair[m] % len(words), minlength=len(words)) for m in (toxic, ~toxic))
    del pair, toxic
    odds = np.log((df1 + 0.5) / (n1 + 1)) - np.log((df0 + 0.5) / (n0 + 1))
    tells = np.where([len(w) >= 3 for w in words], odds * np.sqrt(df1) * (df1 >= 3), 0)
    marks: list[int] = []
    pool = [i for i in np.argsort(-tells, kind="stable")[:200] if tells[i] > 0]
    profile = Landmarks([words[i] for i in pool]) if pool else None
    if profile is not None:
        gram = np.clip(profile.table.T @ profile.table, 0, 1)
        left = tells[pool].copy()
        while len(marks) < LANDMARKS and left.max() > 0:
            i = int(left.argmax())
            marks.append(pool[i])
            left *= 1 - 0.9 * gram[i] ** 2
            left[i] = 0
    if not marks:
        return float((y > 0).mean())
    ids, k = kernels_of(words, Landmarks([words[i] for i in marks]))
    plain = ids[np.argsort(-(k.max(1) * np.log1p(df0[ids]) * (df1[ids] * n0 < 3 * df0[ids] * n1)), kind="stable")[: 4 * ORDINARY]]
    marks += [i for i in plain.tolist() if i not in marks and df0[i] > 0][:ORDINARY]
    final = Landmarks([words[i] for i in marks])
    ids, k = kernels_of(words, final)
    gram = np.clip(final.table.T @ final.table, 0, 1)
    gram = np.where(gram >= CUT, gram, 0) ** POWER
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    good = value > 1e-6
    nystroem = vector[:, good] / np.sqrt(value[good])
    feature = k @ nystroem
    row_of = np.full(len(words), -1, np.int64)
    row_of[ids] = np.arange(len(ids))
    use = row_of[word] >= 0
    # Sentences as bags of near words; equal bags of harmless documents are one row with a count.
    o = np.lexsort((word[use], sent[use]))
    w_of, s_of, d_of = word[use][o], sent[use][o], doc[use][o]
    begin = np.flatnonzero(np.concatenate([[True], s_of[1:] != s_of[:-1]])) if len(s_of) else np.zeros(0, np.int64)
    x = np.add.reduceat(feature[row_of[w_of]], begin, axis=0) if len(begin) else np.zeros((0, feature.shape[1]))
    owner = d_of[begin]
    start = np.zeros(len(words))
    start[marks] = np.maximum(tells[marks], 0)
    score = np.maximum.reduceat(start[w_of], begin) if len(begin) else np.zeros(0)
    bad = np.flatnonzero(y[owner] < 0)
    rows, count = np.unique(np.round(x[bad], 4), axis=0, return_counts=True)
    rows, count = np.concatenate([rows, np.zeros((1, x.shape[1]))]), np.append(count, 50)
    # Telling landmarks with a letter put in count as toxic sentences too, half as much as the true ones.
    rng = np.random.default_rng(3)
    sure = [words[i] for i in marks if odds[i] > 2 and len(words[i]) >= 4]
    broken = [v[:i] + bytes([97 + int(rng.integers(26))]) + v[i:] for v in sure for i in rng.integers(1, len(v) + 1, 4).tolist()]
    odd = np.zeros((len(broken), feature.shape[1]))
    ids, k = kernels_of(broken, final)
    odd[ids] = k @ nystroem
    w = np.zeros(x.shape[1] + 1)
    for _ in range(ROUNDS):
        o = np.lexsort((-score, owner))
        best = o[np.concatenate([[True], owner[o][1:] != owner[o][:-1]])] if len(o) else o
        best = best[y[owner[best]] > 0]
        hard = np.argsort(-(rows @ w[:-1]), kind="stable")[:HARD]  # the harmless sentences that now score highest
        target = np.concatenate([np.ones(len(best)), np.ones(len(odd)), -np.ones(len(hard))])
        times = np.concatenate([np.ones(len(best)), np.full(len(odd), len(best) / max(1, 2 * len(odd))), count[hard]])
        w = support_vectors(np.concatenate([x[best], odd, rows[hard]]), target, times)
        score = x @ w[:-1]
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, score)
    slope, offset = logistic(np.where(np.isfinite(best), best, 0.0), y)
    return [words[i] for i in marks], nystroem @ w[:-1], float(slope), float(offset)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, total_bytes: int = TOTAL_BYTES):
    rows = labelled_sample(docs, labels, "toxic", max_rows, max_bytes, total_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for b in batches for x in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "y"))))
        model = fit([t for _, t, _ in got], np.array([1 if y == 1 else -1 for *_, y in got], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # One task of a bounded sample, on an executor: the driver holds only the landmarks.
    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got[0]) if got else fit([], np.zeros(0))


def score(docs: DataFrame, model) -> DataFrame:
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    words, weight, slope, offset = model
    shared = docs.sparkSession.sparkContext.broadcast((words, weight))  # LANDMARKS + ORDINARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values(Landmarks(shared.value[0]), shared.value[1])
        for b in batches:
            out = np.zeros(b.num_rows)
            for c in chunks(b.column("text")):
                out[c.rows] = document_margins(c, values)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(slope * out + offset, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, train(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
