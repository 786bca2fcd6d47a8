"""The driver's tables as entity frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelace.operators.entity import Entities
from treelace.sources.scratch import written

LINE_COLUMNS = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark: SparkSession, sf_dir: str, name: str, key: str) -> Entities:
    """Rows of a table as documents name/*."""
    return Entities.of(table(spark, sf_dir, name), f"{name}/*", key)


_views: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """What changes when a table's files do: their number and bytes, and when the folder was changed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(p)
    return size.getFileCount(), size.getLength(), fs.getFileStatus(p).getModificationTime()


def _view(spark: SparkSession, sf_dir: str, name: str, sources: tuple[str, ...], make) -> DataFrame:
    """A nested view as a table of its own, made once for each state of its sources: documents are put together when they come in."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *[_stamp(spark, f"{sf_dir}/{s}.parquet") for s in sources])
    if key not in _views:
        _views[key] = written(make())
    return _views[key]


def nest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, lines): each order's lines in order of all their columns, since no few of them are a key."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE_COLUMNS))).alias("lines"))


def nest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines; an order without lines has an empty list."""
    o, li = table(spark, sf_dir, "orders"), lines(spark, sf_dir)
    empty = F.array().cast(li.schema["lines"].dataType)
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").drop("l_orderkey").withColumn("lines", F.coalesce("lines", empty))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nest_lines() as a stored view."""
    return _view(spark, sf_dir, "lines", ("lineitem",), lambda: nest_lines(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> Entities:
    """Documents orders/*: nest_orders() as a stored view."""
    return Entities.of(_view(spark, sf_dir, "orders", ("orders", "lineitem"), lambda: nest_orders(spark, sf_dir)), "orders/*", "o_orderkey")


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, xs): the quantities of each order that has lines, in the lines' order."""
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.transform("lines", lambda x: x["l_quantity"]).alias("xs"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, m): for each nation and market segment a map from customer name to balance."""
    c = table(spark, sf_dir, "customer")
    pairs = F.map_from_entries(F.collect_list(F.struct("c_name", "c_acctbal")))
    return c.groupBy(F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("k")).agg(pairs.alias("m"))
