"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each of its character trigrams is drawn from language l with
probability theta_l * p(trigram | l). Expectation-maximisation estimates theta from the trigram
likelihoods of the learned languages; the set of languages is grown greedily from the likeliest
one, and a language joins only if it raises the log-likelihood by more than a penalty for its
parameter (PENALTY times half the logarithm of the number of trigrams, as in the Bayesian
information criterion). Most documents need no iteration: the log-likelihood is concave in theta,
so its gradient at the single-language vertex bounds what any further languages could gain, and a
document whose bound is below the penalty keeps its one language, exactly as EM would decide.

Trigrams run over lower-cased letters, with one mark for every run of other characters, and are
hashed into N_BUCKETS, so a model has a fixed size for each language.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelace.llm.common import blocks, crc_mod, read_tables, ship, task, utf8

N_BUCKETS = 1 << 16
#: Labelled documents that the model is fitted on at most, by the order of a hash of their ids.
MAX_TRAIN_DOCS = 20_000
SMOOTHING = 0.5
PENALTY = 4.0
EM_STEPS = 40
#: Share of the model's probability that is spread evenly, so that no trigram is impossible.
FLOOR = 0.02
UNKNOWN = "und"
#: Trigrams of a block up to which the screen by the gradient is vectorised over all of them.
MAX_TRIGRAMS = 1 << 21
#: Pipeline: a document is kept if its main language holds at least this share of it.
MIN_SHARE = 0.5

_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """For each code point below 65536 its lower case if it is a letter, else 0."""
    global _fold
    if _fold is None:
        t = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _fold = t
    return _fold


def _letters(cp: np.ndarray) -> np.ndarray:
    out = _folding()[np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    if len(high):
        kinds, inverse = np.unique(cp[high], return_inverse=True)
        out[high] = np.array([k if unicodedata.category(chr(k))[0] == "L" else 0 for k in kinds.tolist()], np.uint32)[inverse]
    return out


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, the n + 1 offsets of the rows' trigrams, rows with a letter)."""
    n = len(off) - 1
    # code points of all rows at once; the rows' character offsets follow from the UTF-8 lead bytes
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    text = raw.tobytes().decode("utf-8", "replace")
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = lead[off] if len(cp) == lead[-1] else np.cumsum([0, *(len(raw[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(off, off[1:]))])
    low = _letters(cp)
    letter = low != 0
    any_letter = np.concatenate([[0], np.cumsum(letter)])[at]
    has = np.diff(any_letter) > 0
    # a mark before and after every run of letters: keep letters and the first character of every gap
    row = np.repeat(np.arange(n), np.diff(at))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = at[:-1][np.diff(at) > 0]
    keep[first] = True
    low, row = low[keep], row[keep]
    # rows are fenced by two marks, so trigrams never cross them
    starts = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(starts)
    to = np.arange(len(low)) + 2 * (row + 1)
    seq = np.zeros(len(low) + 2 * n + 2, np.uint32)
    seq[to] = low
    mix = seq[:-2] * _M[0] + seq[1:-1] * _M[1] + seq[2:] * _M[2]
    mix ^= mix >> np.uint32(15)
    mix *= np.uint32(0x2C1B3C6D)
    b = (mix >> np.uint32(16)).astype(np.int32)
    # trigrams of a row: those that start at its leading mark up to its last letter; none for a row without letters
    valid = np.zeros(len(b), bool)
    begin = starts[:-1] + 2 * np.arange(1, n + 1) - 1
    mark = np.zeros(len(b) + 1, np.int32)
    live = has & (size > 0)
    np.add.at(mark, begin[live], 1)
    np.add.at(mark, np.minimum(begin[live] + size[live], len(b)), -1)
    valid = np.cumsum(mark[:-1]) > 0
    # a trigram of marks only says nothing
    valid &= (seq[:-2] | seq[1:-1] | seq[2:]) != 0
    cum = np.concatenate([[0], np.cumsum(valid)])
    edge = np.minimum(np.concatenate([begin, [len(b)]]), len(b))
    return b[valid], cum[edge], has


class MixtureModel:
    """log p(bucket | language) for each learned language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * N_BUCKETS)
        self.p = np.ascontiguousarray(((1 - FLOOR) * p + FLOOR / N_BUCKETS).T)  # (bucket, language)
        self.logp = np.log(self.p).astype(np.float32)
        self.p = self.p.astype(np.float64)

    def infer(self, bucket: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Languages of one document's trigrams, and their shares, largest first."""
        b, c = np.unique(bucket, return_counts=True)
        p, n = self.p[b], len(bucket)
        single = c @ np.log(p)
        chosen = [int(np.argmax(single))]
        theta, best = np.ones(1), float(single[chosen[0]])
        cost = PENALTY * 0.5 * np.log(max(n, 2))
        while len(chosen) < len(self.languages):
            gain = c @ (p / (p[:, chosen] @ theta)[:, None]) - n
            gain[chosen] = -np.inf
            if gain.max() <= cost:
                break
            trial = None
            for l in np.flatnonzero(gain > cost):
                t, ll = self._em(p[:, [*chosen, l]], c, np.append(theta * 0.9, 0.1))
                if trial is None or ll > trial[2]:
                    trial = (int(l), t, ll)
            if trial is None or trial[2] - best <= cost:
                break
            chosen, theta, best = [*chosen, trial[0]], trial[1], trial[2]
        order = np.argsort(-theta, kind="stable")
        return [chosen[k] for k in order], theta[order]

    @staticmethod
    def _em(p: np.ndarray, c: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, float]:
        ll = -np.inf
        for _ in range(EM_STEPS):
            w = p * theta
            s = w.sum(axis=1)
            new = float(c @ np.log(s))
            theta = (c / s) @ w / c.sum()
            if new - ll < 1e-3:
                break
            ll = new
        return theta, new

    def infer_block(self, bucket: np.ndarray, off: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
        """infer() for each range of off; empty ranges give no language."""
        n = np.diff(off)
        out: list[tuple[list[int], np.ndarray]] = [([], np.zeros(0))] * len(n)
        if len(bucket) > MAX_TRIGRAMS:  # counts of distinct trigrams are bounded, a row for each trigram isn't
            return [self.infer(bucket[a:b]) if b > a else x for x, a, b in zip(out, off[:-1].tolist(), off[1:].tolist())]
        live = np.flatnonzero(n > 0)
        if not len(live):
            return out
        at = off[:-1][live]
        single = np.add.reduceat(self.logp[bucket], at, axis=0, dtype=np.float64)
        top = np.argmax(single, axis=1)
        p = self.p[bucket]
        base = p[np.arange(len(bucket)), np.repeat(top, n[live])]
        gain = np.add.reduceat(p / base[:, None], at, axis=0) - n[live][:, None]
        gain[np.arange(len(live)), top] = -np.inf
        cost = PENALTY * 0.5 * np.log(np.maximum(n[live], 2))
        one = np.ones(1)
        for k, i in enumerate(live.tolist()):
            out[i] = ([int(top[k])], one) if gain[k].max() <= cost[k] else self.infer(bucket[off[i] : off[i + 1]])
        return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAIN_DOCS) -> MixtureModel:
    """Trigram counts of each language, over at most about max_docs rows, those of least id hash.

    Rows with a null language or text teach nothing. The counts are added up on the executors; the
    driver gets N_BUCKETS numbers for each language at most.
    """
    ship(labelled.sparkSession)
    use = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = use.count()
    if n > max_docs:
        use = use.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int((1 << 40) * max_docs / n))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, off = utf8(batch.column(0))
            langs = batch.column(1).to_pylist()
            for lo, hi in blocks(np.diff(off)):
                b, cut, _ = trigrams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                names = sorted(set(langs[lo:hi]))
                which = np.repeat([names.index(x) for x in langs[lo:hi]], np.diff(cut))
                for k, x in enumerate(names):
                    sums[x] = sums.get(x, 0) + np.bincount(b[which == k], minlength=N_BUCKETS)
        for x, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])

    src = use.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    got = src.mapInArrow(task("langid", run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), N_BUCKETS))
    where = {x: k for k, x in enumerate(langs)}
    if langs:
        counts[[where[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return MixtureModel(langs, counts)


def predict(docs: DataFrame, model: MixtureModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, languages): main language, its share, and all languages with shares.

    A null or letterless text gives `und`, 0 and no languages, and so does a model without
    languages. Repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    packed = spark.sparkContext.broadcast(model)  # a fixed size for each language
    src = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    mix = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        m: MixtureModel = packed.value
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for lo, hi in blocks(np.diff(off), 1 << 20):
                if m.languages:
                    b, cut, _ = trigrams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    got = m.infer_block(b, cut)
                else:
                    got = [([], np.zeros(0))] * (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([m.languages[x[0]] if x else UNKNOWN for x, _ in got], pa.string()),
                        pa.array([min(1.0, float(t[0])) if x else 0.0 for x, t in got], pa.float64()),
                        pa.array([[{"lang": m.languages[k], "share": float(s)} for k, s in zip(x, t)] for x, t in got], mix),
                    ],
                    names=[id_col, "lang_pred", "score", "languages"],
                )

    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(task("langid", run), f"{id_col} {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def filter_rows(docs: DataFrame, model: MixtureModel, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows, with all their columns, whose main language holds min_share of them or more; `und` goes."""
    spark = docs.sparkSession
    ship(spark)
    packed = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m: MixtureModel = packed.value
        for batch in batches:
            raw, off = utf8(batch.column(at))
            keep: list[bool] = []
            for lo, hi in blocks(np.diff(off), 1 << 20):
                b, cut, _ = trigrams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                keep += [bool(x) and float(t[0]) >= min_share for x, t in m.infer_block(b, cut)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task("langid", run), docs.schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    fold = crc_mod("doc_id", 4)
    model = train(docs.where(fold != 2))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
