"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master may do without; then it is a local folder of this process."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="treelace-"))
    return conf.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: later plans start from it. It goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/treelace-scratch/{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is None:
                return
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone before Python ends
            return
