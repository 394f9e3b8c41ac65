"""Bringing spans found elsewhere back to their documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import numbered
from .common import blocks, utf8, written

#: Stands for a null id while documents are grouped by id.
NULL_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents as id (null replaced) and t (null is empty), and names.

    Rows of one id and text are one document. If an id has several texts, documents are numbered in order of (id, digest
    of the text), ``id`` is that number, and names has it with the ``name`` it stands for; else names is None.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    several = rows.select("id", F.xxhash64("t").alias("x")).groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("b")).filter("a <> b")
    if several.isEmpty():
        return rows, None
    rows = rows.withColumn("sha", F.sha2("t", 256))
    names = written(numbered(rows.select("id", "sha").distinct().orderBy("id", "sha"), "key"))
    rows = rows.join(names, ["id", "sha"]).select(F.col("key").alias("id"), "t")
    return rows, names.select("key", F.col("id").alias("name"))


def named(out: DataFrame, names: DataFrame | None, id_col: str) -> DataFrame:
    """Results with the input's ids again."""
    if names is not None:
        out = out.join(names, F.col("id") == F.col("key")).select(F.col("name").alias("id"), *(c for c in out.columns if c != "id"))
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed("id", id_col)


def with_spans(keyed_docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document with its array of (s, e) spans, null where there are none, and its text compressed (``texts``).

    Texts are compressed before they are shuffled: one by one they still take a quarter less than by the shuffle.
    """

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for batch in blocks(batches, "t", 1 << 23):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([pack(t) for t in utf8(batch.column("t"))], pa.binary())], names=["id", "z"])

    listed = spans.groupBy(F.col("id").alias("sid")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return keyed_docs.mapInArrow(compress, "id long, z binary").join(listed, F.col("id") == F.col("sid"), "left").select("id", "z", "spans")


def texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return map(unpack, batch.column("z").to_pylist())


def span_arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Starts and ends of the spans of each row of a batch."""
    column = batch.column("spans")
    offsets = column.offsets.to_numpy()
    flat = column.values
    s, e = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    for i in range(batch.num_rows):
        a, b = offsets[i], offsets[i + 1]
        yield (s[a:b], e[a:b]) if column.is_valid()[i].as_py() and b > a else None


def covered(n: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which of n positions lie in a span."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, s, 1)
    np.add.at(edges, e, -1)
    return np.cumsum(edges[:n]) > 0


def parcels(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "parcel"])


def by_bucket(batches: Iterator[pa.RecordBatch], size: Callable[[bytes], int], limit: int) -> Iterator[tuple[bool, list[bytes]]]:
    """Parcels of one bucket after another, from rows sorted by bucket.

    A bucket of up to ``limit`` bytes (by ``size``) comes as one list, after False. A larger one comes in lists of
    about so many bytes, after True, so that what a task holds is bounded whatever a bucket has.
    """
    now, held, total, large = None, [], 0, False
    for batch in batches:
        for bucket, parcel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now:
                if held:
                    yield large, held
                now, held, total, large = bucket, [], 0, False
            n = size(parcel)
            if held and total + n > limit:
                yield True, held
                held, total, large = [], 0, True
            held.append(parcel)
            total += n
    if held:
        yield large, held


FOUND = "id long, s long, e long, h1 long, h2 long"


def found_batch(ids: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Spans that repeat, as rows of ``FOUND``."""
    none = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (ids, s, e)), none, none], names=["id", "s", "e", "h1", "h2"])


def window_batch(ids: np.ndarray, s: np.ndarray, window: int, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    """Windows still to be compared, with their 128-bit digest, as rows of ``FOUND``."""
    digests = [pa.array(h.view(np.int64)) for h in (h1, h2)]
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (ids, s, s + window)), *digests], names=["id", "s", "e", "h1", "h2"])
