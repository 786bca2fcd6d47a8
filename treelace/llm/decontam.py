"""Benchmark decontamination over a distributed positional inverted index.

The index is a table, partitioned by document: a row is the shard of a block of documents, with the
ascending positions of every term that stands in the block. A phrase is found by starting from the
list of its rarest term in that shard, shifting it by the term's offset in the phrase, and
intersecting with the shifted lists of the next rarest terms until all are used; proximity matches
start from the rarest term too. Shards answer alone, so no posting is shuffled and no common word
or passage makes a hot task, and an index that is stored answers any number of benchmarks.

The benchmark is handed out in blocks of at most MAX_ITEM_BYTES of text. A task takes all blocks in
turn over each shard and holds one of them at a time, so a document's matches are together without
a key, and memory is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelace.llm.common import blocks, materialize, read_tables, ship, task, utf8

WINDOW = 13
#: A document is contaminated if at least 1 in RATIO of its words is hit.
RATIO = 20
#: Bytes of benchmark text that are sent to the executors at once.
MAX_ITEM_BYTES = 1 << 20

#: Bytes that are not part of a word become spaces, A-Z become a-z, all else stays.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and all characters beyond ASCII."""
    return text.translate(_FOLD).split()


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Shard:
    """Postings of a block of documents: for each term the ascending positions where it stands.

    Positions run through all documents of the block; doc_starts has where each document begins.
    """

    def __init__(self, tokens: np.ndarray, doc_starts: np.ndarray, n_terms: int):
        self.doc_starts = doc_starts
        known = np.flatnonzero(tokens >= 0)
        order = np.argsort(tokens[known], kind="stable")
        self.positions = known[order]
        self.counts = np.bincount(tokens[known], minlength=n_terms)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        self.slot = np.zeros(len(tokens), np.int64)  # of a position in its term's list
        self.slot[self.positions] = np.arange(len(self.positions))
        self.term_at = tokens

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, positions, side="right") - 1

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.begin[term + 1]]

    def in_list(self, positions: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whether each position is in the posting list of its term."""
        ok = (positions >= 0) & (positions < len(self.term_at))
        at = np.where(ok, positions, 0)
        if not len(self.term_at):
            return ok
        slot = self.slot[at]
        return ok & (self.term_at[at] >= 0) & (slot >= self.begin[terms]) & (slot < self.begin[terms + 1])

    def phrases(self, phrases: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of phrases, start position) of every occurrence; phrases is (n, size) term ids."""
        n = self.counts[phrases]
        order = np.argsort(n, axis=1, kind="stable")  # rarest first
        rare = order[:, 0]
        anchor = phrases[np.arange(len(phrases)), rare]
        many = self.counts[anchor]
        live = np.flatnonzero(many > 0)
        out_p, out_s = [], []
        for lo, hi in blocks(many[live], 1 << 20):
            rows = live[lo:hi]
            p = np.repeat(rows, many[rows])
            start = self.positions[np.repeat(self.begin[anchor[rows]], many[rows]) + _ranges(many[rows])] - rare[p]
            for step in range(1, size):
                off = order[p, step]
                keep = self.in_list(start + off, phrases[p, off])
                p, start = p[keep], start[keep]
                if not len(p):
                    break
            if len(p):
                keep = (start >= 0) & (self.doc_of(start) == self.doc_of(start + size - 1))
                out_p.append(p[keep])
                out_s.append(start[keep])
        if not out_p:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_p), np.concatenate(out_s)

    def proximity(self, terms: Sequence[int], slop: int) -> list[tuple[int, int]]:
        """(first, last) position of every shortest span of at most slop words with all terms, in any order.

        A span starts at the rarest term or around it; it never crosses documents. A term that is
        given k times must stand k times.
        """
        need: dict[int, int] = {}
        for t in terms:
            need[t] = need.get(t, 0) + 1
        if not need or any(self.counts[t] < k for t, k in need.items()):
            return []
        rare = min(need, key=lambda t: (self.counts[t], t))
        spans = set()
        for at in self.postings(rare):
            doc = int(self.doc_of(np.array([at]))[0])
            lo = max(int(at) - slop + 1, int(self.doc_starts[doc]))
            hi = int(at) + slop
            if doc + 1 < len(self.doc_starts):
                hi = min(hi, int(self.doc_starts[doc + 1]))
            hi = min(hi, len(self.term_at))
            near = sorted((int(x), t) for t in need for x in self._between(t, lo, hi))
            have: dict[int, int] = dict.fromkeys(need, 0)
            left = 0
            for right, (pos, t) in enumerate(near):
                have[t] += 1
                while have[near[left][1]] > need[near[left][1]]:
                    have[near[left][1]] -= 1
                    left += 1
                if all(have[x] >= k for x, k in need.items()) and pos - near[left][0] < slop and near[left][1] is not None:
                    spans.add((near[left][0], near[right][0]))
        best = sorted(spans)
        return [s for s in best if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in best)]

    def _between(self, term: int, lo: int, hi: int) -> np.ndarray:
        p = self.postings(term)
        return p[np.searchsorted(p, lo) : np.searchsorted(p, hi)]


class Benchmark:
    """Terms and phrases of the items of one block."""

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], set]] = {}
        for item_id, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text))
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                by_size.setdefault(n, {}).setdefault(ids[i : i + n], set()).add(item_id)
        self.phrases = [(n, np.array(list(x), np.int64).reshape(-1, n), [sorted(v, key=str) for v in x.values()]) for n, x in sorted(by_size.items())]


def index_block(texts: Sequence[bytes], bench: Benchmark) -> tuple[Shard, np.ndarray]:
    """The shard of some documents for the benchmark's terms, and how many words each has."""
    return Postings.of(texts).shard(bench)


class Postings:
    """All terms of a block of documents, their counts, and their positions term by term."""

    def __init__(self, n_words: np.ndarray, terms: list[bytes], counts: np.ndarray, positions: np.ndarray):
        self.n_words, self.terms, self.counts, self.positions = n_words, terms, counts, positions

    @classmethod
    def of(cls, texts: Sequence[bytes]) -> Postings:
        split = [words(t) for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        ids: dict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        at = np.fromiter((ids[w] for ws in split for w in ws), np.int64, int(n.sum()))
        return cls(n, list(ids), np.bincount(at, minlength=len(ids)), np.argsort(at, kind="stable"))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """The four parts as compressed bytes; positions as the steps from one to the next."""
        steps = np.diff(self.positions, prepend=0).astype("<i8") if len(self.positions) >= 1 << 31 else np.diff(self.positions, prepend=0).astype("<i4")
        parts = (self.n_words.astype("<i8").tobytes(), b" ".join(self.terms), self.counts.astype("<i8").tobytes(), steps.tobytes())
        return tuple(zlib.compress(x, 1) for x in parts)

    @classmethod
    def unpacked(cls, n_words: bytes, terms: bytes, counts: bytes, steps: bytes) -> Postings:
        n_words, terms, counts, steps = map(zlib.decompress, (n_words, terms, counts, steps))
        n, c = np.frombuffer(n_words, "<i8"), np.frombuffer(counts, "<i8")
        wide = "<i4" if len(steps) == 4 * int(c.sum()) else "<i8"
        return cls(n, terms.split(), c, np.cumsum(np.frombuffer(steps, wide), dtype=np.int64))

    def shard(self, bench: Benchmark) -> tuple[Shard, np.ndarray]:
        """The lists of the benchmark's terms."""
        of = np.fromiter(map(bench.vocabulary.get, self.terms, repeat(-1)), np.int64, len(self.terms))
        tokens = np.full(len(self.positions), -1, np.int64)
        tokens[self.positions] = np.repeat(of, self.counts)
        return Shard(tokens, np.cumsum(self.n_words) - self.n_words, len(bench.vocabulary)), self.n_words


def _spans(bench: Benchmark, postings: Postings):
    shard, n_words = postings.shard(bench)
    docs: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    items: dict[int, set] = {}
    for size, phrases, owners in bench.phrases:
        p, s = shard.phrases(phrases, size)
        d = shard.doc_of(s)
        docs.append(d)
        starts.append(s - shard.doc_starts[d])
        ends.append(s - shard.doc_starts[d] + size)
        for a, b in set(zip(d.tolist(), p.tolist())):
            items.setdefault(a, set()).update(owners[b])
    empty = np.zeros(0, np.int64)
    return n_words, *(np.concatenate(x) if x else empty for x in (docs, starts, ends)), items


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of the ranges [start, end), ascending."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _item_blocks(items: DataFrame, id_col: str, text_col: str):
    """The benchmark in blocks of bounded bytes, streamed through the driver one partition at a time."""
    block, size = [], 0
    rows = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(text_col).cast("binary").alias("t")).toLocalIterator()
    for item_id, text in rows:
        if block and size + len(text) > MAX_ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, bytes(text)))
        size += len(text)
    yield block


def build_index(docs: DataFrame, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(ids, n_words, terms, counts, steps): a shard for each block of rows, written to the shared folder.

    Null texts have no words; repeated rows and null ids are rows like others; an empty docs gives
    an index without shards. Other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{doc_text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            data = raw.tobytes()
            for lo, hi in blocks(np.diff(off)):
                parts = Postings.of([data[off[i] : off[i + 1]] for i in range(lo, hi)]).packed()
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in parts)], names=["ids", "n_words", "terms", "counts", "steps"])

    return materialize(src.mapInArrow(task("decontam", run), f"ids array<{kind}>, n_words binary, terms binary, counts binary, steps binary"), "postings")


def _shards(batches):
    """(ids, postings) of the rows of an index."""
    for batch in batches:
        parts = [batch.column(k).to_pylist() for k in range(1, 5)]
        for k, part in enumerate(zip(*parts)):
            yield batch.column(0).slice(k, 1).flatten(), Postings.unpacked(*part)


def _id_kind(index: DataFrame) -> str:
    return index.schema["ids"].dataType.elementType.simpleString()


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", into: str = "doc_id") -> DataFrame:
    """(into, n_words, spans, item_ids) for every document of an index; see find_matches()."""
    packed = _sent(index.sparkSession, items, item_id, item_text)

    def run(batches):
        held = list(_benchmarks(packed, window)) if len(packed) == 1 else None
        for ids, postings in _shards(batches):
            n_words, spans, found = _searched(postings, held or _benchmarks(packed, window))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n_words),
                    pa.array([[{"start": a, "end": b} for a, b in row] for row in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ],
                names=[into, "n_words", "spans", "item_ids"],
            )

    return index.mapInArrow(task("decontam", run), f"`{into}` {_id_kind(index)}, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>")


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, item_id: str = "item_id", item_text: str = "text", into: str = "doc_id") -> DataFrame:
    """(into, item_id, start, end): every shortest span of at most slop words of a document that holds all words of an item, in any order.

    A word that an item has k times must stand k times; an item without words, or with a null id or
    text, matches nothing. start and end are word positions in the document, end exclusive.
    """
    packed = _sent(index.sparkSession, items, item_id, item_text)

    def run(batches):
        for ids, postings in _shards(batches):
            rows: list[tuple[int, str, int, int]] = []
            for block in packed:
                bench = Benchmark(block.value, 1)
                shard, _ = postings.shard(bench)
                for item, text in block.value:
                    for a, b in shard.proximity([bench.vocabulary[w] for w in words(text)], slop):
                        doc = int(shard.doc_of(np.array([a]))[0])
                        rows.append((doc, str(item), a - int(shard.doc_starts[doc]), b + 1 - int(shard.doc_starts[doc])))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=[into, "item_id", "start", "end"])

    return index.mapInArrow(task("decontam", run), f"`{into}` {_id_kind(index)}, item_id string, start long, end long")


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, item_ids) for every document row, by an index of docs.

    spans are the maximal ranges of word positions that windows of the benchmark cover, item_ids
    the ids, as sorted strings, of the items whose windows occur. A window is `window` consecutive
    words of an item; an item of fewer words, but not none, is one window. Null texts have no
    words; items with a null id or text are left out; repeated rows stay repeated; an empty
    benchmark matches nothing; an empty docs gives no rows. Other columns are ignored.
    """
    return phrase_matches(build_index(docs, doc_id, doc_text), items, window, item_id, item_text, doc_id)


def _sent(spark, items: DataFrame, item_id: str, item_text: str) -> list:
    """The blocks of the benchmark as broadcasts, which wait on disk until a worker takes one."""
    return [spark.sparkContext.broadcast(block) for block in _item_blocks(items, item_id, item_text)]


def _benchmarks(packed: list, window: int):
    """The blocks one after the other; a worker keeps none that it is done with."""
    for block in packed:
        bench = Benchmark(block.value, window)
        if getattr(block, "_path", None) and len(packed) > 1:
            del block._value  # it is read from its file again
        yield bench


def _searched(postings: Postings, benchmarks) -> tuple[np.ndarray, list, list]:
    """(words, merged spans, item ids as strings) of a shard's documents, over all blocks of the benchmark."""
    n = len(postings.n_words)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    ids: list[set[str]] = [set() for _ in range(n)]
    for bench in benchmarks:
        _, d, s, e, found = _spans(bench, postings)
        order = np.argsort(d, kind="stable")
        cut = np.searchsorted(d[order], np.arange(n + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            which = order[cut[i] : cut[i + 1]]
            old = np.array(spans[i], np.int64).reshape(-1, 2)
            spans[i] = merged(np.concatenate([old[:, 0], s[which]]), np.concatenate([old[:, 1], e[which]]))
        for i, x in found.items():
            ids[i].update(map(str, x))
    return postings.n_words, spans, ids


def contamination(matches: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to find_matches()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return matches.select(
        "*",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(ratio) * F.col("n_hit") >= F.col("n_words")))


def filter_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, ratio: int = RATIO, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated.

    Rows are judged where they are: a block's shard is searched as it is made and then dropped, so
    no key is needed to find its rows again. Nulls and empties are as in find_matches().
    """
    spark = docs.sparkSession
    ship(spark)
    packed = _sent(spark, items, item_id, item_text)
    at = docs.columns.index(doc_text)

    def run(batches):
        held = list(_benchmarks(packed, window)) if len(packed) == 1 else None
        for batch in batches:
            raw, off = utf8(batch.column(at))
            data = raw.tobytes()
            keep: list[bool] = []
            for lo, hi in blocks(np.diff(off)):
                postings = Postings.of([data[off[i] : off[i + 1]] for i in range(lo, hi)])
                n_words, spans, _ = _searched(postings, held or _benchmarks(packed, window))
                hit = [sum(b - a for a, b in row) for row in spans]
                keep += [not (h and ratio * h >= n) for h, n in zip(hit, n_words.tolist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task("decontam", run), docs.schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = read_tables(spark, sf_dir, "documents", "benchmark")
    out = contamination(find_matches(docs, items))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def digest(ids: Iterable) -> str:
    """items_sha256 of some item ids, for checks outside Spark."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


ORACLE = """
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS g
    FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM win),
grams AS (
    SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
    FROM w, sizes, unnest(range(1, len(ws) - n + 2)) AS u(i) WHERE len(ws) >= n
), occ AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
