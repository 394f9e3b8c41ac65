"""Segments: stored records as Parquet, a folder for each segment; the log before it; recovery and compaction.

Records that repeat are stored as often as they come. A batch without records is a segment without records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FIELDS
from .ingest import accepted, parsed, rejected
from .staging import exists, numbered, numbering, remove


def as_json(records: DataFrame) -> DataFrame:
    """Records as JSON texts (``raw``); an empty source file and line 0 are left out, a null field is written as null."""
    text = lambda *more: F.to_json(F.struct("timestamp", "service", "level", "message", *more), {"ignoreNullFields": "false"})
    file, line = F.coalesce(F.col("source_file") == "", F.lit(False)), F.coalesce(F.col("line_no") == 0, F.lit(False))
    ways = F.when(file & line, text()).when(file, text("line_no")).when(line, text("source_file")).otherwise(text("source_file", "line_no"))
    return records.select(ways.alias("raw"))


def framed(raw: DataFrame) -> DataFrame:
    """Raw records with their length in bytes and checksum, as a log of writes has them."""
    return raw.select("raw", F.octet_length("raw").cast("long").alias("length"), F.crc32(F.col("raw").cast("binary")).alias("crc"))


def intact(frames: DataFrame) -> DataFrame:
    return frames.filter((F.octet_length("raw") == F.col("length")) & (F.crc32(F.col("raw").cast("binary")) == F.col("crc"))).select("raw")


def claim(spark: SparkSession, path: str, owner: str) -> int:
    """The number of the segment that ``owner`` writes: the one it has claimed already, or the next that nobody has.

    Whoever writes into a folder of segments claims numbers there, so that none replaces what another wrote. A number
    is claimed by creating a file that must not exist yet; below ``_claims``, which readers of the folder skip.
    """
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = java.Path(f"{path}/_claims")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    taken = [f.getPath().getName() for f in files.listStatus(folder)]
    for name in taken:
        if name.partition(".")[2] == owner:
            return int(name.partition(".")[0])
    stored = [f.getPath().getName().partition("=")[2] for f in files.listStatus(java.Path(path)) if f.getPath().getName().startswith("segment_id=")]
    number = max((int(n) for n in [*stored, *(t.partition(".")[0] for t in taken)]), default=-1) + 1
    while not files.createNewFile(java.Path(folder, str(number))):
        number += 1
    files.createNewFile(java.Path(folder, f"{number}.{owner}"))
    return number


def write_segment(records: DataFrame, path: str, segment_id: int) -> None:
    """Write one segment, replacing what an interrupted attempt left, with gapless offsets in order of rows."""
    with numbering(records.select(*FIELDS)) as placed:
        placed.write.mode("overwrite").parquet(f"{path}/segment_id={segment_id}")


def add_segment(records: DataFrame, path: str, owner: str | None = None) -> int:
    """Store records as a segment of its own and return its number; an ``owner`` that writes again replaces its own."""
    number = claim(records.sparkSession, path, owner or uuid.uuid4().hex)
    write_segment(records, path, number)
    return number


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """All records with their places; segments are pruned by ``segment_id``."""
    return spark.read.parquet(path).select(*FIELDS, F.col("segment_id").cast("int").alias("segment_id"), F.col("offset").cast("long").alias("offset"))


def next_segment(segments: DataFrame) -> int:
    last = segments.agg(F.max("segment_id")).first()[0]
    return 0 if last is None else last + 1


def recover(log: DataFrame, stored: DataFrame) -> DataFrame:
    """Log entries whose bytes no segment has."""
    return log.join(stored.select("raw").distinct(), "raw", "left_anti")


def sorted_segment(records: DataFrame, by: str = "raw") -> DataFrame:
    """Each segment's records in order of ``by``; segments stay where they are."""
    return records.repartition("segment_id").sortWithinPartitions("segment_id", by)


def compacted(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All records in one new segment with offsets in order of ``by``; repeated ones stay. One segment is left alone."""
    if len(records.select("segment_id").distinct().take(2)) < 2:
        return records
    order = by or ["raw"]
    new = next_segment(records)
    ranged = records.drop("segment_id", "offset").orderBy(*order)
    return numbered(ranged).withColumn("segment_id", F.lit(new))


def recover_segments(log: DataFrame, path: str) -> tuple[int | None, DataFrame]:
    """Recovery as one step: entries of a log (raw, length, crc) that are whole and that no segment has are validated
    again and stored as a new segment. Returns its number, None if nothing was missing, and what was rejected."""
    spark = log.sparkSession
    whole = intact(log)
    missing = recover(whole, as_json(read_segments(spark, path))) if exists(spark, path) and _has_segments(spark, path) else whole
    checked = parsed(missing.withColumnRenamed("raw", "value"))
    with numbering(accepted(checked)) as placed:  # matched and parsed once, then it is known if there is any
        number = None if placed.isEmpty() else claim(spark, path, uuid.uuid4().hex)
        if number is not None:
            placed.write.mode("overwrite").parquet(f"{path}/segment_id={number}")
    return number, rejected(checked)


def _has_segments(spark: SparkSession, path: str) -> bool:
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = java.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return any(f.getPath().getName().startswith("segment_id=") for f in listed)


def compact_segments(spark: SparkSession, path: str, by: list[str]) -> int | None:
    """Write all records as one new segment in order of ``by``, then delete the old ones; None if there is one only.

    Until the new one is complete, readers see the old ones only: it is written aside and moved. Repeated records stay.
    """
    stored = read_segments(spark, path)
    old = [r.segment_id for r in stored.select("segment_id").distinct().collect()]  # a row for each segment
    if len(old) < 2:
        return None
    number = claim(spark, path, uuid.uuid4().hex)
    aside = f"{path}/_new-{number}"
    with numbering(stored.drop("segment_id", "offset").orderBy(*by)) as placed:
        placed.write.mode("overwrite").parquet(aside)
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = java.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(java.Path(aside), java.Path(f"{path}/segment_id={number}"))
    for k in old:
        remove(spark.sparkContext, f"{path}/segment_id={k}")
    return number
