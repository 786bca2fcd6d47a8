"""Quality classifier: naive Bayes support vectors.

Indicators of word unigrams, word bigrams and punctuation runs, hashed into N_FEATURES, are scaled
by their class log-count ratios; a linear hinge-loss model over the scaled indicators is fitted by
dual coordinate descent. A logistic curve fitted on examples that the model has not seen maps its
margin to a score from 0 to 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelace.llm.common import blocks, crc_mod, read_tables, ship, task, utf8

BITS = 18
N_FEATURES = 1 << BITS
#: Labelled documents that the model is fitted on at most, by the order of a hash of their ids.
MAX_TRAIN_DOCS = 10_000
#: One in this many training documents is held back for the logistic curve.
CALIBRATE = 5
ALPHA = 1.0
C = 0.1
EPOCHS = 20

_LETTER = np.zeros(256, np.uint8)  # 0 space, 1 word, 2 punctuation
_LETTER[33:128] = 2
for _r in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _LETTER[_r[0] : _r[1]] = 1
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of every token: runs of word characters and runs of punctuation, lower-cased."""
    kind = _LETTER[raw]
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    change = np.ones(n + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[off] = True  # a row starts a token
    edge = np.flatnonzero(change)
    start, end = edge[:-1], edge[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    # a prefix sum of bytes times powers, shifted back to the token's start, hashes all tokens at once
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOW[raw].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n))])
    h = (c[end] - c[start]) * _powers(_INVERSE, n)[start]
    return _mix(h), np.searchsorted(off, start, side="right") - 1


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, rows ascending: the indicators of every row."""
    h, row = tokens(raw, off)
    same = row[1:] == row[:-1]
    pair = _mix(h[:-1] * np.uint64(3) + h[1:])[same]
    idx = np.concatenate([h, pair]) >> np.uint64(64 - BITS)
    key = np.unique((np.concatenate([row, row[1:][same]]) << BITS) | idx.astype(np.int64))
    return key >> BITS, key & (N_FEATURES - 1)


class NBSVM:
    """Weights for each indicator, an intercept, and the logistic curve of the margin."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, row: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(np.bincount(row, minlength=n), 1)
        return np.bincount(row, self.weights[idx], minlength=n) / np.sqrt(count) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> NBSVM:
    """Fit on lists of indicators with 0/1 labels. With one class only, scores lie on its side."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return NBSVM(np.zeros(N_FEATURES, np.float32), 0.0, 1.0, float(y[0]) if len(y) else 0.0)
    counts = [np.full(N_FEATURES, ALPHA), np.full(N_FEATURES, ALPHA)]
    for r, v in zip(rows, y):
        counts[int(v > 0)][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    seen = (counts[0] + counts[1]) > 2 * ALPHA
    ratio *= seen
    held = np.arange(len(y)) % CALIBRATE == 0
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    cost = np.where(y > 0, C * len(y) / (2 * (y > 0).sum()), C * len(y) / (2 * (y < 0).sum()))
    w, b = _descend(rows, y, ratio, cost, np.flatnonzero(~held))
    model = NBSVM((w * ratio).astype(np.float32), b)
    use = np.flatnonzero(held) if held.any() else np.arange(len(y))
    m = np.array([model.weights[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + b for i in use])
    model.slope, model.shift = _logistic(m, labels[use] > 0)
    return model


def _descend(rows, y, ratio, cost, use) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss: each step solves one example's dual variable exactly."""
    w, b = np.zeros(N_FEATURES), 0.0
    x = {i: (rows[i], ratio[rows[i]] / np.sqrt(max(len(rows[i]), 1))) for i in use.tolist()}
    q = {i: float(v @ v) + 1.0 for i, (_, v) in x.items()}
    alpha = dict.fromkeys(x, 0.0)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(use).tolist():
            idx, v = x[i]
            g = y[i] * (w[idx] @ v + b) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if d := (new - alpha[i]) * y[i]:
                w[idx] += d * v
                b += d
                moved = max(moved, abs(d) * q[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def _logistic(m: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with the targets drawn in a little so that they stay finite."""
    pos, neg = label.sum(), (~label).sum()
    t = np.where(label, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        g = np.array([(p - t) @ m, (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[s @ (m * m), s @ m], [s @ m, s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAIN_DOCS) -> NBSVM:
    """Fit on at most about max_docs labelled rows, those of least id hash; rows with a null label teach nothing."""
    ship(labelled.sparkSession)
    use = labelled.where(F.col(label_col).isNotNull())
    n = use.count()
    if n > max_docs:
        use = use.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int((1 << 40) * max_docs / n))

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for lo, hi in blocks(np.diff(off)):
                row, idx = features(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                lists = [idx[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(lists, pa.binary()), batch.column(2).slice(lo, hi - lo)], names=["label", "idx", "at"])

    src = use.select(F.col(text_col).cast("string"), F.col(label_col).cast("double"), F.xxhash64(id_col))
    got = src.mapInArrow(task("quality", run), "label double, idx binary, at long").toArrow().sort_by("at")
    rows = [np.frombuffer(x, "<i4") for x in got.column("idx").to_pylist()]
    return fit(rows, np.array(got.column("label").to_pylist(), float))


def score(docs: DataFrame, model: NBSVM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every whole text; a null text is empty and gets the intercept's score.

    Repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    packed = spark.sparkContext.broadcast(model)  # N_FEATURES weights, whatever the data
    src = docs.select(id_col, F.col(text_col).cast("string").alias("text"))

    def run(batches):
        m: NBSVM = packed.value
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for lo, hi in blocks(np.diff(off), 1 << 20):
                row, idx = features(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                s = m.score(m.margins(row, idx, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return src.mapInArrow(task("quality", run), f"{id_col} {src.schema[id_col].dataType.simpleString()}, score double, predicted int")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_tables(spark, sf_dir, "documents", "labels")
    known = labels.where(F.col("quality").isNotNull() & (crc_mod("doc_id", 3) != 1)).select("doc_id", "quality")
    n = known.count()
    if n > MAX_TRAIN_DOCS:  # choose the sample before the texts are joined
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * MAX_TRAIN_DOCS / n))
    model = train(docs.select("doc_id", "text").join(known, "doc_id"))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
