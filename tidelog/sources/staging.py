"""Written intermediate tables and gapless offsets."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def staging_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which executors share; a temporary one only where that is unset, which
    is for masters whose executors are on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tidelog-"))
            atexit.register(shutil.rmtree, _own[0], True)
        named = _own[0]
    return f"{named.rstrip('/')}/stage-{uuid.uuid4().hex}"


def remove(context: SparkContext, path: str) -> None:
    """Delete a folder wherever it lies; once the session has stopped it is left to its owner."""
    jvm, java = context._jvm, context._jsc
    if jvm is None or java is None:
        return
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(java.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _numbered(rows: DataFrame, column: str, path: str) -> DataFrame:
    spark = rows.sparkSession
    rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    kept = spark.read.parquet(path)
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(sizes), "_part").withColumn(column, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def numbered(rows: DataFrame, column: str = "offset") -> DataFrame:
    """Rows with their place from 0 (long) in the order of partitions and rows.

    They are written once with their partition and place in it; partitions' sizes, a row for each partition, give
    where each begins. So no task ever holds all rows, and lost tasks can't change what was numbered. What was written
    is deleted when the driver ends.
    """
    path = staging_dir(rows.sparkSession)
    atexit.register(remove, rows.sparkSession.sparkContext, path)
    return _numbered(rows, column, path)


@contextmanager
def numbering(rows: DataFrame, column: str = "offset") -> Iterator[DataFrame]:
    """As ``numbered``, for rows that are used up within: what was written is deleted then."""
    path = staging_dir(rows.sparkSession)
    try:
        yield _numbered(rows, column, path)
    finally:
        remove(rows.sparkSession.sparkContext, path)
