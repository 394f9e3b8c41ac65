"""Shared plumbing: table access, written intermediate tables and batch helpers."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, from ``spark.checkpoint.dir``; a temporary one only where that is unset, which is
    for masters whose executors are on this machine."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return _own_dir


def _remove(context: SparkContext, path: str) -> None:
    """Delete a written table when the driver ends, wherever it lies; a driver that is killed leaves it."""
    jvm, java = context._jvm, context._jsc
    if jvm is None or java is None:  # the session was stopped: the folder is its owner's
        return
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(java.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a cache it survives the loss of executors, and unlike ``checkpoint()`` it computes the rows once and
    keeps them compressed and prunable by column. The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark.sparkContext, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, least: int = 1) -> DataFrame:
    """As ``written``, but partitioned by a column: joins on it move the other side only.

    There are as many parts as shuffles have, or ``least``. The table's name is known to this session only.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    name = f"tidelog_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(parts, column).write.bucketBy(parts, column).sortBy(column).option("path", path).saveAsTable(name)
    atexit.register(_remove, spark.sparkContext, path)
    return spark.table(name)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; sizes the number of buckets, so that a bucket stays as large at any input size."""
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def pieces_for(n_bytes: float, piece_mb: float, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / (piece_mb * 1e6)))


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slice batches into runs of rows of about ``limit`` text bytes (one row at least), to bound temporary arrays."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
