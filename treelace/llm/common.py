"""Shared plumbing of the training-data operators: shipping code, shared tables, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that one vectorised step works on; an Arrow batch is cut into such blocks.
BLOCK_BYTES = 1 << 20

_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_tables: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so workers need no shared PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    if spark.conf.get(_BATCH_CONF, None) in (None, "64m", "67108864b"):  # the default; texts are long
        spark.conf.set(_BATCH_CONF, "4m")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(root)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, top))
    path = os.path.join(tempfile.mkdtemp(), "treelace_code.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = "file://" + os.path.join(tempfile.gettempdir(), "treelace-shared")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends, or by release()."""
    path = f"{shared_dir(spark)}/treelace/{tag}-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treelace_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_treelace_path", None)
        if path and (spark := _tables.pop(path, None)):
            _delete(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of jobs whose frames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _cleanup() -> None:
    for path, spark in list(_tables.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone before Python ends
            return


_clear: list = []
_owner = ""


def owned(clear) -> None:
    """Register what empties a module's worker-side cache."""
    _clear.append(clear)


def _trim() -> None:
    """Give freed memory back to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def task(tag: str, run):
    """run for mapInArrow: caches that an earlier operator left in the worker go first, freed memory goes last."""

    def whole(batches):
        global _owner
        if _owner != tag:
            _owner = tag
            for clear in _clear:
                clear()
            _trim()
        yield from run(batches)
        _trim()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    ship(spark)
    return [table(spark, sf_dir, n) for n in names]


def local_rows(spark: SparkSession, rows: list, schema) -> DataFrame:
    """The driver's own rows as a relation that lives in the plan: no task and no Python worker makes them."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kinds = to_arrow_schema(schema)
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds.types)], names=schema.names), schema)


def free_name(name: str, taken) -> str:
    """name, with underscores in front until no column of `taken` has it, whatever the case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


#: Groups of ids by which the large side of a join is narrowed before it is shuffled: what is broadcast has at most so many rows.
BUCKETS = 1 << 20


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ids; only those that might be are shuffled.

    The others are told by a table of at most BUCKETS hash values, whatever the data.
    """
    bucket, at = F.pmod(F.xxhash64(key), F.lit(BUCKETS)), free_name("near", rows.columns)
    near = ids.select(bucket.alias(at)).distinct()
    tagged = rows.withColumn(at, bucket)
    clear = tagged.join(F.broadcast(near), at, "left_anti").select(*rows.columns)
    asked = tagged.join(F.broadcast(near), at, "left_semi").join(ids.select(key), key, "left_anti").select(*rows.columns)
    return clear.unionByName(asked)


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids, narrowed in the same way before the shuffle."""
    bucket, at = F.pmod(F.xxhash64(key), F.lit(BUCKETS)), free_name("near", rows.columns)
    near = ids.select(bucket.alias(at)).distinct()
    asked = rows.withColumn(at, bucket).join(F.broadcast(near), at, "left_semi")
    return asked.join(ids.select(key), key, "left_semi").select(*rows.columns)


def crc_mod(column, n: int):
    """crc32 of a column's text form, modulo n: the fold of a row. A null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def blocks(lengths: np.ndarray, limit: int = BLOCK_BYTES):
    """(start, end) row ranges whose lengths add up to about limit; a longer row stands alone."""
    start, n = 0, len(lengths)
    ends = np.cumsum(lengths, dtype=np.int64)
    while start < n:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, end
        start = end


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(array) else np.zeros(1, np.int64)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; empty ranges give 0."""
    c = np.concatenate([np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)])
    return c[ends] - c[starts]
