"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight (position, byte) terms. Fingerprints within two bits differ in at
most two bytes, so they share at least MIN_SHARED = 6 of the 8 terms. Lists of single terms hold
a 256th of all fingerprints, so the index keys a posting by four terms at once: the bytes are
taken as four blocks of two, and two untouched blocks are shared by every pair within two bits,
so each such pair meets in at least one of the six block pairs. For a candidate the shared
positional bytes are tallied, pairs below MIN_SHARED go, and the rest are verified by Hamming
distance. Postings longer than MAX_POSTING are not paired: their fingerprints take the exact way
for the rest, in which each links to the 65 values within one bit of it. Two fingerprints are
within two bits exactly if they share such a value, and no value has more than 65 of them, so
that way is linear in any group of near copies.

Equal fingerprints are one class throughout; copies are never paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from itertools import combinations, repeat
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelace.llm.common import blocks, materialize, ship, task, utf8
from treelace.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
MIN_SHARED = 8 - MAX_BITS
#: Fingerprints in a posting up to which its pairs are tallied one by one.
MAX_POSTING = 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the lower-cased words' shingles, repeats included; 0 for a text without words.

    A text of fewer words than size is one shingle. A bit is 1 if set in over half the hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(flat, SEED)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(n) - 1
    starts = (ends - n + 1)[: len(words) - size + 1].tolist()
    shingles = [flat[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id_col, fp long): the fingerprint of every text as a signed 64-bit value. Null text is empty."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            data = raw.tobytes()
            at = off.tolist()
            fp = np.fromiter((fingerprint(data[a:b], size) for a, b in zip(at, at[1:])), np.uint64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    src = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(task("simhash", run), f"{id_col} {src.schema[id_col].dataType.simpleString()}, fp long")


def _byte(col, k: int):
    return F.shiftrightunsigned(col, 8 * k).bitwiseAND(F.lit(255))


def _key(fp, i: int, j: int):
    """The terms of two two-byte blocks, with their positions, as one value."""
    part = lambda b: F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF))
    return F.lit((i * 4 + j) << 32) + F.shiftleft(part(i), 16) + part(j)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints fps(fp) whose components are those of 'within two bits'."""
    pairs = list(combinations(range(4), 2))
    posting = fps.select("fp", F.explode(F.array(*[_key(F.col("fp"), i, j) for i, j in pairs])).alias("key"))
    # sizes are counted before any list is gathered, so the lists below hold MAX_POSTING fingerprints at most
    sizes = posting.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "simhash-lists")
    met = posting.join(sizes, "key")
    short = met.where(F.col("n") <= MAX_POSTING).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    left = short.select("key", "fps", F.posexplode("fps").alias("at", "a"))
    cand = left.select("key", "a", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("b"))
    shared = sum((F.when(_byte(F.col("a"), k) == _byte(F.col("b"), k), 1).otherwise(0) for k in range(8)), F.lit(0))
    cand = cand.withColumn("shared", shared).where(F.col("shared") >= MIN_SHARED)
    near = cand.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    hot = met.where(F.col("n") > MAX_POSTING).select("fp").distinct()
    return near.union(meeting_links(hot)).distinct()


def meeting_links(fps: DataFrame) -> DataFrame:
    """The same edges up to components, by the values within one bit: linear in the number of fingerprints."""
    balls = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    meet = fps.select("fp", F.explode(F.transform(balls, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    stars = meet.groupBy("at").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return stars.select("a", F.explode("fps").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component): the smallest id reachable over links of at most two differing bits.

    Rows with a null id keep their fingerprint and their class's component, but never name one;
    a class of null ids only has a null component. Repeated rows stay repeated; an empty table
    gives an empty result; other columns are ignored.
    """
    fp = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    classes = fp.groupBy("fp").agg(F.min(id_col).alias("first"))
    comp = components(links(classes.select("fp")))
    joined = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = joined.select("fp", "root").join(firsts, "root").select("fp", "component_id")
    return fp.join(ids, "fp").select(id_col, "fp", F.col("component_id"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
