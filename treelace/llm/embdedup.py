"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Unit vectors are projected on random normal directions, shifted and cut into cells of WIDTH; the
cells of k directions are one bucket of one table. Two unit vectors at distance c fall into the
same cell of a direction with a known probability p(c), so k follows from how many vectors there
are (a bucket should hold about BUCKET strangers) and the number of tables from the recall that
pairs exactly at the threshold are to have. Pairs in a bucket are compared by their exact cosine in
double precision, and a pair counts in the first table that it shares only.

Equal vectors are one class with a weight. A bucket of more than BLOCK classes is cut into blocks,
and every pair of blocks is a task of its own; links are counted in place and leave a block as one
count and one edge of a spanning star for each vector, never as pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelace.llm.common import materialize, read_tables, ship, task
from treelace.llm.components import components

THRESHOLD = 0.95
WIDTH = 2.0
RECALL = 0.97
BUCKET = 8
BLOCK = 1024
SEED = 20240


def collision(c: float, width: float = WIDTH) -> float:
    """Chance that two points at distance c share a cell of a random direction."""
    r = width / c
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Hashes:
    """k directions for each of the tables, for vectors of any length; a function of (n, threshold) alone."""

    def __init__(self, n: int, threshold: float):
        near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
        self.k = max(4, round(math.log(max(n, 2) / BUCKET) / -math.log(far)))
        self.tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**self.k)))
        self._drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket keys."""
        dim = unit.shape[1]
        if dim not in self._drawn:
            rng = np.random.default_rng(SEED + dim)
            m = self.k * self.tables
            self._drawn[dim] = rng.standard_normal((dim, m)), rng.uniform(0, WIDTH, m)
        a, b = self._drawn[dim]
        cell = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), self.tables, self.k)
        h = np.full(cell.shape[:2], dim, np.uint64)
        for j in range(self.k):
            h = (h ^ cell[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def _packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, raw): the vector's numbers as bytes; null if it can't link."""
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    dtype = np.dtype("<f4") if kind == "float" else np.dtype("<f8")
    src = vectors.select(F.col(id_col).alias("id"), (F.col(vec_col) if kind == "float" else F.col(vec_col).cast("array<double>")).alias("v"))

    def run(batches):
        for b in batches:
            col = b.column(1)
            flat = col.flatten()
            bad_at = np.asarray(flat.is_null()) if flat.null_count else None
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0))
            ends = np.cumsum(n)
            wrong = ~np.isfinite(x)
            if bad_at is not None:
                wrong |= bad_at
            cum_wrong = np.concatenate([[0], np.cumsum(wrong)])
            cum_live = np.concatenate([[0], np.cumsum(x != 0)])
            x = x + dtype.type(0)  # -0 and 0 are one
            raw = [x[e - k : e].tobytes() if cum_wrong[e] == cum_wrong[e - k] and cum_live[e] > cum_live[e - k] else None for k, e in zip(n.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    return src.mapInArrow(task("embdedup", run), f"id {src.schema['id'].dataType.simpleString()}, raw binary"), dtype


def _unit(raw: list[bytes], dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _run_pairs(n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j within runs of n rows that begin at start."""
    reps = np.concatenate([np.arange(k - 1, -1, -1) for k in n]) if len(n) else np.zeros(0, np.int64)
    rows = np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)]) if len(n) else np.zeros(0, np.int64)
    i = np.repeat(rows, reps)
    ends = np.cumsum(reps)
    return i, i + 1 + np.arange(len(i)) - np.repeat(ends - reps, reps)


class _Links:
    """Link counts and star roots of the rows of some whole runs."""

    def __init__(self, hashes: Hashes, dtype, threshold: float):
        self.hashes, self.dtype, self.threshold = hashes, dtype, threshold

    def __call__(self, t, run, side, rep, weight, raw):
        """t: table, run: ascending run number, side: block of a split bucket or -1, all by row; gives (rep, links, root)."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = []
        for s in np.unique(size):  # lengths never share a bucket but by a collision of hashes
            at = np.flatnonzero(size == s)
            out.append(self._same(t[at], run[at], side[at], rep[at], weight[at], [raw[k] for k in at]))
        return [np.concatenate(x) for x in zip(*out)]

    def _same(self, t, run, side, rep, weight, raw):
        unit = _unit(raw, self.dtype)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        n = np.diff(np.append(first, len(run)))
        pairs_i, pairs_j = [], []
        small = (n > 1) & (n <= 32)
        i, j = _run_pairs(n[small], first[small])
        for k in range(0, len(i), 1 << 17):
            a, b = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= self.threshold
            pairs_i.append(a[hit])
            pairs_j.append(b[hit])
        for s, k in zip(first[n > 32].tolist(), n[n > 32].tolist()):
            for lo in range(s, s + k, 512):
                block = unit[lo : min(lo + 512, s + k)]
                a, b = np.nonzero(block @ unit[lo : s + k].T >= self.threshold)
                up = b > a
                pairs_i.append(a[up] + lo)
                pairs_j.append(b[up] + lo)
        a = np.concatenate(pairs_i) if pairs_i else np.zeros(0, np.int64)
        b = np.concatenate(pairs_j) if pairs_j else np.zeros(0, np.int64)
        keep = (side[a] != side[b]) | (side[a] < 0)  # within a block its own task compares
        a, b = a[keep], b[keep]
        used = np.unique(np.concatenate([a, b]))
        if len(used):
            keys = np.zeros((len(unit), self.hashes.tables), np.int64)
            for k in range(0, len(used), 4096):
                keys[used[k : k + 4096]] = self.hashes.keys(unit[used[k : k + 4096]])
            new = np.ones(len(a), bool)
            for earlier in range(self.hashes.tables):
                new &= (t[a] <= earlier) | (keys[a, earlier] != keys[b, earlier])
            a, b = a[new], b[new]
        links = np.bincount(a, weight[b], minlength=len(unit)) + np.bincount(b, weight[a], minlength=len(unit))
        root = np.arange(len(unit))
        while len(a):  # least row of each linked group
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        live = links > 0
        return rep[live], links[live].astype(np.int64), rep[root[live]]


def link_counts(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    n_links counts the other rows at a cosine of threshold or more that the hashing finds (each
    such pair is found with a chance of RECALL at least); component_id is the smallest id
    reachable by links. A vector that is null, zero, empty, or holds null or non-finite numbers
    links with nothing, and so does a row with a null id, which is never kept. Vectors of different
    lengths don't link. Repeated rows are rows of their own that link with each other; an empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    packed, dtype = _packed(vectors, id_col, vec_col)
    packed = materialize(packed, "emb")
    live = packed.where("raw is not null and id is not null")
    classes = materialize(live.groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "emb-class")
    hashes = Hashes(classes.count(), threshold)

    def hashed(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                for k in range(0, len(at), 2048):
                    part = at[k : k + 2048]
                    keys = hashes.keys(_unit([raw[x] for x in part], dtype))
                    offsets = np.arange(len(part) + 1, dtype=np.int32) * hashes.tables
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], names=["rep", "keys"])

    kind = classes.schema["rep"].dataType.simpleString()
    member = classes.select("rep", "raw").mapInArrow(task("embdedup", hashed), f"rep {kind}, keys array<long>").select("rep", F.posexplode("keys").alias("t", "key"))
    sizes = member.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = member.join(sizes, ["t", "key"])
    cut = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int")
    cells = (
        shared.withColumn("cut", cut)
        .withColumn("own", own)
        .select("rep", "t", "key", "cut", "own", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
        .select("rep", "t", "key", "own", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"))
        .select("rep", "t", "key", "ci", "cj", F.when(F.col("ci") == F.col("cj"), -1).otherwise(F.col("own")).alias("side"))
    )
    rows = cells.join(classes, "rep").repartition("t", "key", "ci", "cj").sortWithinPartitions("t", "key", "ci", "cj")
    find = _Links(hashes, dtype, threshold)

    def linked(batches):
        held = None
        for b in _flushed(batches):
            if b is not None:
                held = b if held is None else pa.concat_batches([held, b])
                if held.num_rows == 0:
                    continue
            if held is None or held.num_rows == 0:
                continue
            t, key, ci, cj = (np.asarray(held.column(k)) for k in (1, 2, 3, 4))
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])])
            end = held.num_rows if b is None else int(np.flatnonzero(new)[-1])  # the last run may go on
            if not end:
                continue
            part = held.slice(0, end)
            rep, links, root = find(t[:end], np.cumsum(new)[:end], np.asarray(part.column(5)), np.asarray(part.column(0)), np.asarray(part.column(7)).astype(float), part.column(6).to_pylist())
            held = held.slice(end)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(root)], names=["rep", "links", "root"])

    rows = rows.select("rep", "t", "key", "ci", "cj", "side", "raw", "weight")
    found = materialize(rows.mapInArrow(task("embdedup", linked), f"rep {kind}, links long, root {kind}"), "emb-links")
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    full = (
        classes.join(counts, "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("raw", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    joined = packed.withColumn("k", F.when(F.col("id").isNotNull(), F.col("raw"))).join(full.withColumnRenamed("raw", "k"), "k", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )


def _flushed(batches):
    """The batches, and None after the last."""
    yield from batches
    yield None


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    (vectors,) = read_tables(spark, sf_dir, "embeddings")
    return link_counts(vectors)
