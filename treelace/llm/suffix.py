"""Removal of repeated byte strings by suffix arrays with two-stage sorting.

A byte goes if a string of SPAN bytes that covers it also starts earlier in the corpus. One suffix
array over the corpus fits no machine, so the suffixes are dealt out such that equal strings of
SPAN bytes always meet:

1. Every window of SPAN bytes names its anchor, the k-gram of least hash in it (the rightmost of
   ties). That depends on the window's bytes only, so equal windows have equal anchors. Neighbouring
   windows mostly share one; they form a segment, of some 130 bytes for 30 windows.
2. Segments meet by their anchors. Those with the same bytes are one class, of which the first
   stays and the others are repeated throughout. Segments whose anchor no other class has are done.
3. The first segments of all other classes are sorted, block by block of whole anchors: a suffix
   array by two-stage sorting directly sorts only the suffixes that are smaller than their
   successors and induces the rest by scanning the buckets of first bytes; common prefixes of
   adjacent suffixes then show which windows are equal, and all but the first of each go.

Copies within FOLD segments are folded before the shuffle, and neighbours that go are one range.
Anchors with very many classes, such as a common line in changing surroundings, are found
beforehand; they are dealt out by class, and their windows then meet one by one by a 128-bit digest
instead. An anchor that only turns out to have so many when its classes meet goes that way too, so
no task holds more than HOT_CLASSES classes of one. Equal segments are told by 64-bit hashes of
their bytes and their length, of which the anchor's hash is a second one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelace.llm.common import BUCKETS, free_name, free_shuffles, materialize, owned, read_tables, release, ship, task, utf8

SPAN = 100
#: Bytes of an anchor; a window has SPAN - GRAM + 1 of them.
GRAM = 40
#: Text that one vectorised step works on; a longer text is taken in slices that overlap by SPAN - 1 bytes.
SLICE = 1 << 20
#: Suffix text of one array.
ARRAY_BYTES = 1 << 20
#: Segments among which copies are folded before the shuffle, some 8 MB of text.
FOLD = 1 << 19
#: Classes of an anchor beyond which its windows meet one by one; to be known beforehand, it needs so many in FOLD segments,
#: and to be one of the MAX_HOT with most. What is missed there is found when the classes meet.
HOT_CLASSES = 5_000
HOT_IN_FOLD = 8
MAX_HOT = 100_000
_POS = np.uint64((1 << 30) - 1)
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
owned(_cache.clear)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, of which the last array is kept."""
    if not _cache or len(_cache[0][0]) < n:
        full = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SLICE + SPAN) - 1, b, np.uint64)]), dtype=np.uint64)
        _cache[0] = full(_BASE), full(_INV)
    p, q = _cache[0]
    return p[:n], q[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(raw: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(row, start, windows, anchor hash, content hash) of all segments; start is from the row's begin."""
    n, w = len(raw), span - gram + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    p, q = _powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p, out=c[1:])
    grams = _mix((c[gram:] - c[:-gram]) * q[: n - gram + 1])
    low = (grams & ~_POS) | (_POS - np.arange(len(grams), dtype=np.uint64))
    have = 1
    while have * 2 <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[: n - span + 1], low[w - have :][: n - span + 1])
    anchor = (_POS - (low & _POS)).astype(np.int64)
    mark = np.zeros(n + 1, np.int32)
    size = np.diff(off)
    ok = size >= span
    np.add.at(mark, off[:-1][ok], 1)
    np.add.at(mark, off[:-1][ok] + size[ok] - span + 1, -1)
    at = np.flatnonzero(np.cumsum(mark[: n - span + 1]) > 0)
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    a = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
    start, many = at[first], np.diff(np.append(first, len(at)))
    end = start + many + span - 1
    body = _mix(((c[end] - c[start]) * q[start]) ^ _mix(many.astype(np.uint64) + np.uint64(span)))
    row = np.searchsorted(off, start, side="right") - 1
    return row, start - off[row], many, grams[a[first]], body


# ---- suffix arrays


def packed(text: np.ndarray) -> np.ndarray:
    """Seven characters of 9 bits from every position, up to the first sentinel 0 and none beyond."""
    key = np.zeros(len(text), np.uint64)
    alive = np.ones(len(text), bool)
    padded = np.concatenate([text, np.zeros(7, text.dtype)])
    for j in range(7):
        ch = padded[j : j + len(text)]
        key = (key << np.uint64(9)) | np.where(alive, ch, 0).astype(np.uint64)
        alive &= ch != 0
    return key


def two_stage(text: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of text, characters 1 to 256 with sentinels 0; the last must be one.

    A sentinel ends a comparison; suffixes equal up to theirs are in the order of position.
    """
    n = len(text)
    key = packed(text) if key is None else key
    # smaller than the successor, by the next other character; runs of one character share it
    change = np.flatnonzero(text[1:] != text[:-1])
    run_end = np.append(change, n - 1)
    run = np.searchsorted(run_end, np.arange(n))
    run_char = text[run_end]
    small_run = np.append(run_char[:-1] < run_char[1:], False)
    zero = text == 0
    direct = small_run[run] & ~zero  # sentinels are in order of position without sorting
    larger = ~direct & ~zero
    b = _sorted(np.flatnonzero(direct), key)
    edges = np.searchsorted(text[b], np.arange(258)) if len(b) else np.zeros(258, np.int64)
    lists: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Hand the larger predecessors of suffixes in bucket c to their buckets; those in c itself come back."""
        prev = found[found > 0] - 1
        prev = prev[larger[prev]]
        ch = text[prev]
        own = prev[ch == c] if c else prev[:0]
        rest = ch > c
        prev, ch = prev[rest], ch[rest]
        if len(prev):
            order = np.argsort(ch, kind="stable")
            prev, ch = prev[order], ch[order]
            cut = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
            for x, part in zip(ch[cut].tolist(), np.split(prev, cut[1:])):
                lists[x].append(part)
        return own

    for c in range(257):
        if c == 0:
            part = np.flatnonzero(zero)
            out.append(part)
            induce(part, 0)
            continue
        queue = np.concatenate(lists[c]) if lists[c] else np.zeros(0, np.int64)
        lists[c] = []
        while len(queue):
            out.append(queue)
            queue = induce(queue, c)
        part = b[edges[c] : edges[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out)


def _sorted(pos: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Suffixes at pos in order, by seven characters at a time; only what is still equal is looked at again."""
    if not len(pos):
        return pos
    k = key[pos]
    order = np.argsort(k, kind="stable")
    sa, k = pos[order], k[order]
    depth = 7
    start = np.concatenate([[True], k[1:] != k[:-1]])
    ends = (k & np.uint64(511)) == 0  # a sentinel was met: order of position is final
    at = np.flatnonzero(~ends & ~(start & np.append(start[1:], True)))
    group = np.cumsum(start)
    group = group[at]
    while len(at):
        nxt = sa[at] + depth
        k = key[np.minimum(nxt, len(key) - 1)]
        order = np.lexsort((k, group))
        sa[at] = sa[at][order]
        k = k[order]
        start = np.concatenate([[True], (group[1:] != group[:-1]) | (k[1:] != k[:-1])])
        keep = ((k & np.uint64(511)) != 0) & ~(start & np.append(start[1:], True))
        group = np.cumsum(start)[keep]
        at = at[keep]
        depth += 7
    return sa


def equal_windows(parts: list[bytes], windows: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, part, offset) of all windows of span bytes that stand more than once; parts[i] has windows[i] of them."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size)
    begin = ends - size
    text = np.zeros(ends[-1], np.uint16)
    body = np.ones(ends[-1], bool)
    body[ends - 1] = False
    text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    key = packed(text)
    sa = two_stage(text, key)
    mark = np.zeros(len(text) + 1, np.int32)
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + windows, -1)
    sa = sa[(np.cumsum(mark[:-1]) > 0)[sa]]  # only suffixes that start a window
    same = np.zeros(len(sa), bool)
    alive = np.arange(1, len(sa))
    for o in [*range(0, span - 6, 7), max(span - 7, 0)]:  # adjacent common prefixes, up to span
        alive = alive[key[sa[alive] + o] == key[sa[alive - 1] + o]]
    same[alive] = True
    group = np.cumsum(~same)
    member = same.copy()
    member[:-1] |= same[1:]
    pos = sa[member]
    part = np.searchsorted(ends, pos, side="right")
    return group[member], part, pos - begin[part]


# ---- stages


def _sliced(off: np.ndarray):
    """Blocks of (row, begin, end) slices of about SLICE bytes in all; slices of a row overlap by SPAN - 1."""
    block, size = [], 0
    for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if b - a < SPAN:
            continue
        for x in range(a, max(a + 1, b - SPAN + 1), SLICE):
            y = min(b, x + SLICE + SPAN - 1)
            if block and size + y - x > SLICE + SPAN:
                yield block
                block, size = [], 0
            block.append((r, x, y))
            size += y - x
    if block:
        yield block


def _block_segments(batch):
    """Segments of a batch of (doc, th, text), block by block."""
    doc, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    raw, off = utf8(batch.column(2))
    for block in _sliced(off):
        text = np.concatenate([raw[x:y] for _, x, y in block])
        cut = np.concatenate([[0], np.cumsum([y - x for _, x, y in block])])
        row, start, many, anchor, body = segments(text, cut)
        src = np.array([r for r, _, _ in block])[row]
        start = start + np.array([x - off[r] for r, x, _ in block])[row]
        yield doc[src], th[src], start, many, anchor.view(np.int64), body.view(np.int64)


def _folded(batches):
    """(doc, th, start, many, anchor, body, again) of FOLD segments at a time, ascending by (doc, th, start).

    again marks segments whose bytes stand earlier among them.
    """
    held, n = [], 0
    for batch in _flushed(batches):
        for part in _block_segments(batch) if batch is not None else [None]:
            if part is not None:
                held.append(part)
                n += len(part[0])
            if n >= FOLD or (part is None and n):
                yield _fold([np.concatenate(x) for x in zip(*held)])
                held, n = [], 0


def _fold(cols):
    doc, th, start = cols[:3]
    later = (doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & ((th[1:] > th[:-1]) | (th[1:] == th[:-1]) & (start[1:] >= start[:-1]))
    if not later.all():
        order = np.lexsort((start, th, doc))
        cols = [x[order] for x in cols]
    anchor, body = cols[4], cols[5]
    order = np.argsort(body, kind="stable")
    a, b = anchor[order], body[order]
    again = np.zeros(len(body), bool)
    again[order[1:][(b[1:] == b[:-1]) & (a[1:] == a[:-1])]] = True
    return *cols, again


def _runs(doc, th, start, end):
    """Maximal runs (doc, th, start, end) of ranges that ascend by (doc, th, start)."""
    if not len(doc):
        return doc, th, start, end
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return doc[at], th[at], start[at], end[np.append(at[1:], len(doc)) - 1]


def _id(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))


def _again(docs: DataFrame, id_col: str) -> DataFrame | None:
    """(near): the groups of ids that hold all repeated ones, at most BUCKETS; None if no id is repeated."""
    again = docs.groupBy(_id(id_col).alias("doc")).agg(F.count("*").alias("n")).where("n > 1")
    near = materialize(again.select(_bucket("doc").alias("near")).distinct(), "sa-again")
    return None if near.isEmpty() else near


def _bucket(column):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS))


def _identified(docs: DataFrame, near: DataFrame | None, id_col: str, text_col: str, names: tuple[str, str, str], *others) -> DataFrame:
    """(doc, th, text) under these names, and others: a null id counts as the smallest; th tells texts of one id apart, and is 0 where no id of the group is repeated."""
    doc, th, text = names
    src = docs.select(*others, _id(id_col).alias(doc), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    if near is None:
        return src.withColumn(th, F.lit(0).cast("long"))
    hit = free_name("hit", src.columns)
    key = free_name("near", src.columns)
    tagged = src.withColumn(key, _bucket(doc)).join(F.broadcast(near.select(F.col("near").alias(key), F.lit(True).alias(hit))), key, "left")
    return tagged.withColumn(th, F.when(F.col(hit), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop(key, hit)


def _once(docs: DataFrame, near: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, text) with repeated rows once; only texts whose id may be repeated are shuffled, and that once."""
    src = _identified(docs, near, id_col, text_col, ("doc", "th", "text")).select("doc", "th", "text")
    if near is None:
        return src
    once = src.withColumn("near", _bucket("doc")).join(F.broadcast(near), "near", "left_semi").select("doc", "th", "text").distinct()
    rest = src.withColumn("near", _bucket("doc")).join(F.broadcast(near), "near", "left_anti").select("doc", "th", "text")
    return rest.unionByName(materialize(once, "sa-once"))


def _hot_anchors(src: DataFrame) -> list[int]:
    """Anchors with very many classes: at most MAX_HOT, whatever the data. The result decides how work is dealt out, never what is found."""

    def run(batches):
        for *_, anchor, _, again in _folded(batches):
            a, n = np.unique(anchor[~again], return_counts=True)
            often = n >= HOT_IN_FOLD
            yield pa.RecordBatch.from_arrays([pa.array(a[often]), pa.array(n[often].astype(np.int64))], names=["anchor", "n"])

    sums = src.mapInArrow(task("suffix", run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return [r["anchor"] for r in sums.where(F.col("n") >= HOT_CLASSES).orderBy(F.desc("n"), "anchor").limit(MAX_HOT).collect()]


_ROW = "kind int, anchor long, doc long, th long, start int, many int"
REPEATED, SHARED, HOT = 0, 1, 2
_FIELD = np.int64((1 << 31) - 1)


def _rows(kind, anchor, doc, th, start, many) -> pa.RecordBatch:
    cols = (np.broadcast_to(np.int32(kind), len(doc)) if np.isscalar(kind) else kind.astype(np.int32), anchor, doc, th, start.astype(np.int32), many.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "anchor", "doc", "th", "start", "many"])


def _classes(src: DataFrame, hot: list[int]) -> DataFrame:
    """_ROW: ranges of segments that are repeated throughout, and first segments of classes that share their anchor with others."""
    ship(src.sparkSession)
    packed_hot = src.sparkSession.sparkContext.broadcast(np.array(sorted(hot), np.int64))

    def scan(batches):
        """A segment is dealt out by its anchor, by its class where the anchor is hot, and anyhow where nothing is left to decide."""
        h = packed_hot.value
        for doc, th, start, many, anchor, body, again in _folded(batches):
            d, t, a, e = _runs(doc[again], th[again], start[again], (start + many + SPAN - 1)[again])
            done = (d * np.int64(0x9E3779B97F4A7C1) + a * np.int64(0x85EBCA77C2B2AE3), np.zeros(len(d), np.int64), d, t, (a << 31) | (e - a - SPAN + 1))
            new = ~again
            doc, th, start, many, anchor, body = (x[new] for x in (doc, th, start, many, anchor, body))
            is_hot = np.isin(anchor, h) if len(h) else np.zeros(len(anchor), bool)
            place = (np.where(is_hot, np.int64(HOT - 4), np.int64(SHARED)) << 62) | (start << 31) | many
            open_ = (np.where(is_hot, body, anchor), np.where(is_hot, anchor, body), doc, th, place)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(done, open_)], names=["deal", "other", "doc", "th", "place"])

    rows = src.mapInArrow(task("suffix", scan), "deal long, other long, doc long, th long, place long")
    rows = rows.repartition("deal").sortWithinPartitions("deal", "other", "doc", "th", "place")

    def decide(batches):
        """Rows of a deal are one run, in which equal `other` is one class, of which the first row stays.

        First rows are held until their run ends, or has more than HOT_CLASSES classes.
        """
        held = None  # columns (kind, deal, other, doc, th, start, many) of first rows whose run is open
        last = None  # deal and other of the row before
        over = None  # the deal of an open run whose first rows are already given out
        for b in _flushed(batches):
            if b is not None:
                deal, other, doc, th, place = (np.asarray(b.column(k)) for k in range(5))
                kind, start, many = (place >> 62) & 3, (place >> 31) & _FIELD, place & _FIELD
                gone = kind == REPEATED
                rest = np.flatnonzero(~gone)
                d, o = deal[rest], other[rest]
                before = np.concatenate([[False if last is None or not len(rest) else (d[0], o[0]) == last], (d[1:] == d[:-1]) & (o[1:] == o[:-1])])[: len(rest)]
                if len(rest):
                    last = (d[-1], o[-1])
                gone[rest[before]] = True
                yield _rows(REPEATED, np.zeros(int(gone.sum()), np.int64), doc[gone], th[gone], start[gone], many[gone])
                new = [x[rest[~before]] for x in (kind, deal, other, doc, th, start, many)]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None or not len(held[0]):
                continue
            kind, deal = held[:2]
            first = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1]]))
            size = np.diff(np.append(first, len(deal)))
            given = (deal[first] == over) if over is not None else np.zeros(len(first), bool)
            whole = np.ones(len(first), bool)
            if b is not None:  # the last run may go on
                whole[-1] = size[-1] > HOT_CLASSES or given[-1]
                over = deal[first[-1]] if whole[-1] else None
            many_classes = np.repeat((size > HOT_CLASSES) | given, size)
            ask = np.repeat(whole, size) & ((kind == HOT) | np.repeat(size > 1, size) | many_classes)
            k, d, o, doc, th, start, many = (x[ask] for x in held)
            anchor = np.where(k == HOT, o, d)
            yield _rows(np.where(many_classes[ask], HOT, k), anchor, doc, th, start, many)
            open_ = ~np.repeat(whole, size)
            held = [x[open_] for x in held]

    return rows.mapInArrow(task("suffix", decide), _ROW)


def _flushed(batches):
    yield from batches
    yield None


def _with_texts(src: DataFrame, lists: DataFrame) -> DataFrame:
    """src joined to lists(doc, th, ...); texts of ids that lists can't have are dropped before the shuffle.

    The filter is a table of at most BUCKETS hash values, whatever the data.
    """
    near = lists.select(_bucket("doc").alias("bucket")).distinct()
    return src.withColumn("bucket", _bucket("doc")).join(F.broadcast(near), "bucket", "left_semi").drop("bucket").join(lists, ["doc", "th"])


def _cut(batches, each):
    """Calls each(doc, th, text bytes, asked segments) for every row of (doc, th, text, asked)."""
    for batch in batches:
        raw, off = utf8(batch.column(2))
        data = raw.tobytes()
        asked = batch.column(3)
        flat = asked.flatten()
        cols = [np.asarray(flat.field(k)) for k in range(3)]
        cuts = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(asked)))])
        yield each(np.asarray(batch.column(0)), np.asarray(batch.column(1)), data, off, cols, cuts)


def _shared_ranges(src: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, th, start, end) that go since an equal window stands earlier in another class of the anchor."""
    asked = classes.where(F.col("kind") == SHARED).groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "start", "many")).alias("asked"))

    def cut(batches):
        def each(doc, th, data, off, cols, cuts):
            anchor, start, many = cols
            row = np.repeat(np.arange(len(doc)), np.diff(cuts))
            at = off[row] + start
            body = [data[a:b] for a, b in zip(at.tolist(), (at + many + SPAN - 1).tolist())]
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc[row]), pa.array(th[row]), pa.array(start), pa.array(many), pa.array(body, pa.binary())], names=["anchor", "doc", "th", "start", "many", "body"])

        for b in _cut(batches, each):
            for k in range(0, b.num_rows, 50_000):
                yield b.slice(k, 50_000)

    rows = _with_texts(src, asked).select("doc", "th", "text", "asked").mapInArrow(task("suffix", cut), "anchor long, doc long, th long, start int, many int, body binary")
    rows = rows.repartition("anchor").sortWithinPartitions("anchor")

    def find(batches):
        held = None
        for b in _flushed(batches):
            if b is not None:
                held = b if held is None else pa.concat_batches([held, b])
            if held is None or not held.num_rows:
                continue
            anchor = np.asarray(held.column(0))
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.asarray(pa.compute.binary_length(held.column(5))).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            done = 0
            edges = np.append(first[1:], held.num_rows) if b is None else first[1:]  # the last run may go on
            for e in range(len(edges)):
                last = e + 1 == len(edges)
                if edges[e] > done and (total[edges[e]] - total[done] >= ARRAY_BYTES or (last and b is None)):
                    yield _array_ranges(held.slice(done, edges[e] - done))
                    done = int(edges[e])
            held = held.slice(done)

    return rows.mapInArrow(task("suffix", find), "doc long, th long, start int, end int")


def _array_ranges(rows: pa.RecordBatch) -> pa.RecordBatch:
    doc, th, start, many = (np.asarray(rows.column(k)) for k in (1, 2, 3, 4))
    group, part, offset = equal_windows(rows.column(5).to_pylist(), many.astype(np.int64))
    pos = start[part] + offset
    order = np.lexsort((pos, th[part], doc[part], group))
    g = group[order]
    later = order[np.concatenate([[False], g[1:] == g[:-1]])] if len(g) else order
    d, t, p = doc[part[later]], th[part[later]], pos[later]
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order]
    d, t, a, e = _runs(d, t, p, p + SPAN)
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(a.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc", "th", "start", "end"])


def _hot_ranges(src: DataFrame, classes: DataFrame) -> DataFrame:
    """The same for hot anchors: windows of distinct classes meet by their digests, combined before the shuffle."""
    asked = classes.where(F.col("kind") == HOT).groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "start", "many")).alias("asked"))

    def cut(batches):
        def each(doc, th, data, off, cols, cuts):
            _, start, many = cols
            row = np.repeat(np.repeat(np.arange(len(doc)), np.diff(cuts)), many)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            pos = np.repeat(start, many) + inner
            at = (off[row] + pos).tolist()
            digest = [xxhash.xxh3_128_digest(data[a : a + SPAN]) for a in at]
            return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(doc[row]), pa.array(th[row]), pa.array(pos.astype(np.int32))], names=["digest", "doc", "th", "start"])

        yield from _cut(batches, each)

    rows = materialize(_with_texts(src, asked).select("doc", "th", "text", "asked").mapInArrow(task("suffix", cut), "digest binary, doc long, th long, start int"), "sa-hot")
    where = F.struct("doc", "th", "start")
    first = rows.groupBy("digest").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(first, "digest").where(where != F.col("first")).select("doc", "th", "start", (F.col("start") + SPAN).alias("end"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, ranges): the byte ranges of each text that go, not yet merged; texts that lose nothing are left out.

    Strings are judged on the input. Order is by id, then start; ids are whole numbers, a null id
    counts as the smallest. Rows of one id with different texts are different documents, in the order
    of a hash of their texts, which is th (0 where the id is not repeated); repeated rows are one
    document, which repeats nothing of itself but what starts earlier in it.
    """
    return _ranges(docs, _again(docs, id_col), id_col, text_col)


def _ranges(docs: DataFrame, near: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of whole numbers: their order says which copy is first")
    src = _once(docs, near, id_col, text_col)
    hot = _hot_anchors(src)
    classes = materialize(_classes(src, hot), "sa-classes")
    free_shuffles(spark)
    ranges = classes.where(F.col("kind") == REPEATED).select("doc", "th", "start", (F.col("start") + F.col("many") + SPAN - 1).alias("end"))
    ranges = ranges.union(_shared_ranges(src, classes))
    if not classes.where(F.col("kind") == HOT).isEmpty():
        ranges = ranges.union(_hot_ranges(src, classes))
    out = materialize(ranges.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "sa-ranges")
    release(classes)
    free_shuffles(spark)
    return out


def merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows."""
    r = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    top = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > top[:-1]])
    at = np.flatnonzero(new)
    return np.stack([r[at, 0], top[np.append(at[1:], len(r)) - 1]], axis=1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, into: tuple[str, str, str] = ("n_bytes", "spans", "kept")) -> DataFrame:
    """docs with the columns of `into`: n_bytes, spans array<struct<start,end>> (maximal removed runs) and kept binary; kept is null where nothing goes.

    With whole_characters, what is left of a character that a removed run cuts goes from kept too.
    A null text has no bytes; an empty table gives no rows. Columns of docs stay as they are; one
    that is named as in `into` is an error, since the result would have it twice.
    """
    if twice := set(into) & set(docs.columns):
        raise ValueError(f"columns {sorted(twice)} are in docs; name the result's columns by `into`")
    near = _again(docs, id_col)
    ranges = _ranges(docs, near, id_col, text_col)
    names = docs.columns
    doc, th, text, key, hit = (free_name(x, [*names, *into]) for x in ("doc", "th", "text", "near", "hit"))
    src = _identified(docs, near, id_col, text_col, (doc, th, text), *[F.col(f"`{c}`") for c in names])
    groups = ranges.select(_bucket("doc").alias(key)).distinct().withColumn(hit, F.lit(True))
    tagged = src.withColumn(key, _bucket(doc)).join(F.broadcast(groups), key, "left").drop(key)
    n_bytes = F.octet_length(text).cast("long").alias(into[0])
    span_type = "array<struct<start:int,end:int>>"
    own = [F.col(f"`{c}`") for c in names]
    plain = tagged.where(F.col(hit).isNull()).select(*own, n_bytes, F.array().cast(span_type).alias(into[1]), F.lit(None).cast("binary").alias(into[2]))
    found = ranges.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("ranges").alias(key))
    asked = tagged.where(F.col(hit)).join(found, [doc, th], "left").select(*own, n_bytes, key, text)

    def cut(batches):
        for batch in batches:
            k = len(names)
            raw, off = utf8(batch.column(k + 2))
            data = raw.tobytes()
            asked = batch.column(k + 1)
            flat = asked.flatten()
            pair = np.stack([np.asarray(flat.field(0)), np.asarray(flat.field(1))], axis=1) if len(flat) else np.zeros((0, 2), np.int64)
            cuts = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(asked), 0)))])
            spans, kept = [], []
            for i in range(batch.num_rows):
                r = pair[cuts[i] : cuts[i + 1]]
                m = merged(r) if len(r) else r
                spans.append([{"start": a, "end": b} for a, b in m.tolist()])
                edges = [0, *m.ravel().tolist(), int(off[i + 1] - off[i])]
                base = int(off[i])
                left = b"".join(data[base + a : base + b] for a, b in zip(edges[::2], edges[1::2])) if len(m) else None
                kept.append(left.decode("utf-8", "ignore").encode() if whole_characters and left else left)
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=[*names, *into])

    return plain.unionByName(asked.mapInArrow(task("suffix", cut), plain.schema))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    out = remove_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    kept = F.coalesce("kept", F.col("text").cast("binary"), F.lit("").cast("binary"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]], span: int = SPAN) -> list[tuple[int, int, int, int, str]]:
    """The rows of op4 by a set of all windows, for checks."""
    seen: set[bytes] = set()
    out = []
    for doc, t in sorted(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            w = t[i : i + span]
            if w in seen:
                gone[i : i + span] = True
            seen.add(w)
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
