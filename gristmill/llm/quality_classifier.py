"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of byte bigrams, hashed byte trigrams and shapes of word n-grams (which of 2 or 4 neighbouring
words are equal, as AAAA or AABB, and the share of the document's n-grams with that shape). Each is scaled by its class log-count ratio; a linear hinge-loss model is
fitted on the scaled indicators by dual coordinate descent; the weights are interpolated with their mean magnitude, and
a logistic curve over margins of rows that the descent did not see turns margins into probabilities.

Labels are read from rows that ``held_out`` leaves, at most ``MAX_ROWS`` of them (least hash of doc_id), of at most
``MAX_BYTES`` bytes each and ``TOTAL_BYTES`` in all (stated bounds); every whole text is scored. The fit takes those rows'
feature lists on the driver: two numbers of 4 bytes for each byte of text at most, a fifth of that as measured.
Null and empty texts have no features and get the score of the bias. Unknown labels (null, not 0 or 1) are not used; of
repeated labelled rows one counts. Repeated rows are scored each. With no usable labels of both classes every score is the
share of label 1, or 0.5. Empty table: no rows. Extra columns are ignored. Very long texts are a step of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import chunks, held_out, labelled_sample

MAX_ROWS, MAX_BYTES, TOTAL_BYTES = 6000, 200_000, 32 << 20
#: Features: 2**16 byte bigrams, 2**16 - SHAPES hashed byte trigrams, and shapes of word n-grams by how often they occur.
SIZE, SHAPES = 1 << 17, 64
#: A shape's features say that it makes up more than each of these parts of the document's n-grams.
LEVELS = (0.0, 1 / 16, 1 / 4, 1 / 2)
ALPHA, COST, BETA, EPOCHS = 1.0, 1.0, 0.25, 12


def word_shapes(n: int, wdoc: np.ndarray, equal: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) from which neighbouring words are equal; ``same``: both belong to one document."""
    out = []
    for first, width in ((0, 3), (8, 1)):
        if (m := len(equal) - width + 1) <= 0:
            continue
        inside = np.logical_and.reduce([same[i : i + m] for i in range(width)])
        code = sum(equal[i : i + m].astype(np.int64) << i for i in range(width))[inside]
        counts = np.bincount(wdoc[:m][inside] * 8 + code, minlength=n * 8).reshape(n, 8)
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        out += [np.stack([d, SIZE - SHAPES + (first + c) * len(LEVELS) + k]) for k, level in enumerate(LEVELS) for d, c in [np.nonzero(share[:, : 1 << width] > level)]]
    return tuple(np.concatenate(out, 1)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, document in these rows, feature) with distinct features of each document, for some texts at a time."""
    for c in chunks(texts):
        b = c.data.astype(np.uint32)
        n = len(c.rows)
        doc = np.repeat(np.arange(n, dtype=np.uint32), c.end - c.begin)  # the space after a text is its own
        two = (b[:-1] << np.uint32(8)) | b[1:]
        three = ((two[:-1] * np.uint32(0x9E3779B1) + b[2:] * np.uint32(0x85EBCA77)) >> np.uint32(16)) % np.uint32((1 << 16) - SHAPES) + np.uint32(1 << 16)
        wdoc, _, _, h = c.words(lower=False)
        same = wdoc[1:] == wdoc[:-1] if len(h) > 1 else np.zeros(0, bool)
        shapes = word_shapes(n, wdoc, same & (h[1:] == h[:-1]) if len(h) > 1 else same, same)
        inside2, inside3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
        key = np.concatenate([(doc[:-1][inside2] << np.uint32(17)) | two[inside2], (doc[:-2][inside3] << np.uint32(17)) | three[inside3]]) if n < 1 << 15 else None
        if key is None:  # very many tiny texts in one step
            key = np.concatenate([(doc[:-1][inside2].astype(np.uint64) << np.uint64(17)) | two[inside2], (doc[:-2][inside3].astype(np.uint64) << np.uint64(17)) | three[inside3]])
        key = np.concatenate([key, (shapes[0].astype(key.dtype) << key.dtype.type(17)) | shapes[1].astype(key.dtype)])
        key.sort()
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        yield c.rows, (key >> key.dtype.type(17)).astype(np.int64), (key & key.dtype.type(SIZE - 1)).astype(np.int64)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 7, times: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2/2 + cost * sum of hinge losses, rows (each ``times`` as often) weighted so that both classes count alike."""
    times = np.ones(len(y)) if times is None else times
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(y)), np.random.default_rng(seed)
    norm = np.array([v @ v + 1 for v in values])
    upper = cost * times * np.where(y > 0, times.sum() / (2 * max(1, times[y > 0].sum())), times.sum() / (2 * max(1, times[y < 0].sum())))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[x] += step * y[i] * v
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve (Newton's steps, smoothed targets)."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, margin.std())
    m, p = margin / scale, np.array([1.0, 0.0])
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (s * (1 - s))[:, None]) + 1e-6 * np.eye(2), x.T @ (s - t) + 1e-6 * p)
        p -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return p[0] / scale, p[1]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Of each feature: log of its smoothed share of the positive rows' indicators over that of the negative rows'."""
    counts = {s: ALPHA + np.bincount(np.concatenate([x for x, z in zip(rows, y) if z == s]), minlength=size).astype(float) for s in (1, -1)}
    return np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))


def fit(rows: list[np.ndarray], y: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, float]:
    """Weights for indicators, such that the logistic of their sum plus the offset is the probability of +1."""
    if len(set(y.tolist())) < 2:
        p = min(max((y > 0).mean() if len(y) else 0.5, 0.01), 0.99)
        return np.zeros(size), float(np.log(p / (1 - p)))
    late = np.arange(len(y)) % 5 == 4
    if len(set(y[late].tolist())) < 2 or len(set(y[~late].tolist())) < 2:
        late[:] = False
    train = np.flatnonzero(~late)
    ratio = log_count_ratios([rows[i] for i in train], y[train], size)
    w = dual_coordinate_descent([rows[i] for i in train], [ratio[rows[i]] / np.sqrt(len(rows[i]) + 1.0) for i in train], y[train], size)
    bias, w = w[-1], w[:-1]
    mean = np.abs(w).mean()
    w = ratio * (BETA * mean + (1 - BETA) * w)
    check = np.flatnonzero(late) if late.any() else train
    margin = np.array([w[rows[i]].sum() / np.sqrt(len(rows[i]) + 1.0) + bias for i in check])
    a, b = logistic(margin, y[check])
    return a * w, float(a * bias + b)


def train(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, total_bytes: int = TOTAL_BYTES) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of labelled rows outside the held-out part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, doc, f in features(b.column("text")):
                cut = np.searchsorted(doc, np.arange(len(rows) + 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)).cast(pa.int64()), b.column("y").take(pa.array(rows)).cast(pa.int32()), pa.array([f[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "y", "f"])

    got = labelled_sample(docs, labels, label, max_rows, max_bytes, total_bytes).mapInArrow(run, "doc_id long, y int, f binary").toPandas().sort_values("doc_id")
    order = np.random.default_rng(0).permutation(len(got))
    return fit([np.frombuffer(got["f"].iloc[i], "<u4").astype(np.int64) for i in order], np.where(got["y"].to_numpy()[order] == 1, 1, -1) if len(got) else np.zeros(0))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of each whole text."""
    weight, bias = model[0].astype(np.float32), model[1]
    shared = docs.sparkSession.sparkContext.broadcast(weight)  # SIZE numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, bias)
            for rows, doc, f in features(b.column("text")):
                n = np.bincount(doc, minlength=len(rows))
                out[rows] = bias + np.bincount(doc, shared.value[f], minlength=len(rows)) / np.sqrt(n + 1.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, train(docs, labels, "quality"))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
