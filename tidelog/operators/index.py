"""The inverted index as tables: postings of tokens and the vocabulary.

Null and empty messages have no tokens. A token that a record repeats is one posting; records that are stored twice are
at two places and have postings for each. Empty tables have an empty index. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_hash, tokens
from ..model import PLACE
from ..sources.staging import remove, staging_dir

#: What a byte is in a lower token; 0 for those between tokens.
_LOWER = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _LOWER[_c] = ord(chr(_c).lower())
#: So many tokens are held by a Python worker before their run is written, and rows of one are sent on at once.
RUN_TOKENS, SENT = 8_000_000, 65_536


def token_occurrences(logs: DataFrame) -> DataFrame:
    return logs.select(F.explode(tokens("message")).alias("token"), *PLACE)


def postings(logs: DataFrame) -> DataFrame:
    """(token, segment_id, offset), once for each record that has the token; repetitions go before any shuffle."""
    return logs.select(F.explode(F.array_distinct(tokens("message"))).alias("token"), *PLACE)


def vocabulary(index: DataFrame) -> DataFrame:
    return index.select("token").distinct()


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("records"))


def lookup(index: DataFrame, token: str) -> DataFrame:
    return index.filter(F.col("token") == token).select(*PLACE)


def prefix(index: DataFrame, start: str) -> DataFrame:
    return vocabulary(index.filter(F.col("token").startswith(start)) if start else index)


def contains_token(index: DataFrame, token: str) -> DataFrame:
    """One row: whether the vocabulary has the token."""
    return index.filter(F.col("token") == token).agg((F.count("*") > 0).alias("present"))


def index_size(index: DataFrame) -> DataFrame:
    return vocabulary(index).agg(F.count("*").alias("index_size"))


def shard_sizes(index: DataFrame, shards: int) -> DataFrame:
    """Distinct tokens of each shard that has any, by the token's wrapping hash."""
    return vocabulary(index).groupBy(token_hash("token", shards).alias("shard")).agg(F.count("*").alias("tokens"))


def posting_lists(index: DataFrame, run: int = 100_000) -> DataFrame:
    """(token, run, places): lists of places in runs of segments, so that a frequent token makes no endless list."""
    listed = index.groupBy("token", F.expr(f"segment_id div {run}").cast("int").alias("run"))
    return listed.agg(F.array_sort(F.collect_list(F.struct(*PLACE))).alias("places"))


def posting_rows(lists: DataFrame) -> DataFrame:
    return lists.select("token", F.explode("places").alias("p")).select("token", "p.*")


def write_index(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Files sorted by token, so that lookups and prefixes skip row groups and pages.

    Each task sorts the postings of the records it reads and writes them, as a run of its own: nothing is shuffled or
    staged, and a token is looked up in every run. With ``partitions``, there are so many files at most and each has a
    range of tokens, which lookups skip whole; a frequent token spans several. For that postings are staged first, as
    ranges are set by a sample, which would tokenize all records a second time.
    """
    spark, by = index.sparkSession, ("token", *PLACE)
    if partitions is None:
        index.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
        return
    staged = staging_dir(spark)
    try:
        index.write.parquet(staged)
        spread = spark.read.parquet(staged).repartitionByRange(partitions, *by)
        spread.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    finally:
        remove(spark.sparkContext, staged)


def write_runs(logs: DataFrame, path: str) -> None:
    """The postings of records, as ``write_index`` writes them in runs, without sorting rows: Python workers number a run's
    distinct tokens and sort numbers. A task with more than ``RUN_TOKENS`` tokens writes several runs one after another."""
    kinds = dict(logs.select(*PLACE).dtypes)
    schema = ", ".join(["token string", *(f"`{p}` {kinds[p]}" for p in PLACE)])
    logs.select("message", *PLACE).mapInArrow(_sorted_runs, schema).write.mode("overwrite").parquet(path)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower tokens of texts in order, coded by a dictionary, and the row of each."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    low = _LOWER[data]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = inside[heads]  # a text's first token isn't a part of the last one's of the text before
    chars = low[inside]
    bounds = np.append(np.flatnonzero(begins[inside]), len(chars)).astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(chars))
    return tokens.dictionary_encode(), np.searchsorted(ends, np.flatnonzero(begins), side="right") - 1


def _sorted_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    placed: list[pa.RecordBatch] = []
    many = records = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        coded, row = _split(batch.column(0))
        held.append((coded.dictionary, coded.indices.to_numpy(), (row + records).astype(np.int32)))
        placed.append(batch.select(PLACE))
        many, records = many + len(row), records + batch.num_rows
        if many > RUN_TOKENS:
            yield from _run(held, placed)
            held, placed, many, records = [], [], 0, 0
    if many:
        yield from _run(held, placed)


def _run(held: list[tuple[pa.Array, np.ndarray, np.ndarray]], placed: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of token and place: each is a number, of its token and its record in their orders."""
    places = pa.Table.from_batches(placed).combine_chunks()
    order = pc.sort_indices(places, sort_keys=[(p, "ascending") for p in PLACE], null_placement="at_start")
    places, n = places.take(order).combine_chunks(), len(order)
    place = np.empty(n, np.int64)
    place[order.to_numpy()] = np.arange(n)
    words = pa.concat_arrays([d for d, _, _ in held]).dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    vocabulary, rank, parts, at = words.dictionary.take(order), rank[words.indices.to_numpy()], [], 0
    for known, codes, rows in held:
        parts.append(rank[at : at + len(known)][codes] * n + place[rows])
        at += len(known)
    held.clear()
    numbers = np.concatenate(parts)
    del parts
    numbers.sort()
    numbers = numbers[np.append(True, numbers[1:] != numbers[:-1])]  # a token that a record repeats is one posting
    for i in range(0, len(numbers), SENT):
        word, record = np.divmod(numbers[i : i + SENT], n)
        there = places.take(pa.array(record)).combine_chunks()
        tokens = vocabulary.take(pa.array(word)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([tokens, *(there.column(p).combine_chunks() for p in PLACE)], ["token", *PLACE])


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) segment of each complete part of an index; of parts that others hold, only the wider ones."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = java.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    found = [tuple(map(int, n.removeprefix("part-").split("-"))) for n in names if n.startswith("part-") and files.exists(java.Path(folder, f"{n}/_SUCCESS"))]
    kept: list[tuple[int, int]] = []
    for first, last in sorted(found, key=lambda p: (p[0], -p[1])):
        if not kept or last > kept[-1][1]:
            kept.append((first, last))
    return kept


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The index and the last segment it holds; None and -1 if there is none. Its parts' names say so, nothing is read."""
    parts = _parts(spark, path)
    if not parts:
        return None, -1
    return spark.read.parquet(*(f"{path}/part-{a}-{b}" for a, b in parts)), parts[-1][1]


def update_index(logs: DataFrame, path: str, last: int | None = None, whole: bool = False) -> int:
    """Add a part with the postings of segments that the index doesn't hold yet, up to ``last``; with ``whole`` all are
    indexed anew as one part and the others go. Returns the last segment held."""
    spark = logs.sparkSession
    parts = _parts(spark, path)
    held = parts[-1][1] if parts and not whole else -1
    if last is None:
        last = logs.agg(F.max("segment_id")).first()[0]
    if last is None or last <= held:
        return held
    new = logs.filter((F.col("segment_id") > held) & (F.col("segment_id") <= last))
    write_runs(new, f"{path}/part-{held + 1}-{last}")
    for a, b in parts if whole else ():
        if (a, b) != (0, last):
            remove(spark.sparkContext, f"{path}/part-{a}-{b}")
    return last
