"""Continuous ingestion: micro-batches of JSON records become segments; checkpoints take the place of a write-ahead log."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import update_index
from ..sources.ingest import accepted, parsed, rejected
from ..sources.segments import add_segment, read_segments


def start(spark: SparkSession, source: str, table: str, rejects: str, checkpoint: str, seconds: int | None = 5, max_files: int = 1000, index: str | None = None) -> StreamingQuery:
    """Ingest files of JSON lines as they arrive in ``source``.

    A batch is one segment, which the batch claims by its name, so a batch that is run again replaces what it wrote and
    nothing else. With ``index``, its postings are then added to the index there. ``max_files`` bounds a batch, which is
    the backpressure. With ``seconds`` None all that is there is ingested, then it ends.
    """
    owner = f"batch-{zlib.crc32(checkpoint.encode()):08x}"
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(source)
    checked = parsed(lines.filter("value <> ''"))

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            add_segment(accepted(batch), table, f"{owner}-{number}")
            rejected(batch).write.mode("overwrite").parquet(f"{rejects}/batch_id={number}")
        finally:
            batch.unpersist()
        if index:
            update_index(read_segments(spark, table), index)

    writer = checked.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()
