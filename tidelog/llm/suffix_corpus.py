"""Suffix order of a whole corpus by the distributed difference-cover method.

Texts are strings of positive integers that end for good: what follows an end is less than any symbol. Triples at places
1 and 2 modulo 3 are sorted over all tasks and named by how many are less; unless all names differ, the names of each
string make two strings that are ordered in the same way, with a third of its length. The suffixes at places 0 modulo 3
follow from a symbol and the rank of what comes after it; how many of them are before each sampled suffix, and the other
way round, is read from two sorts of both together. Every step is a sort or a join of rows, one for each suffix; only a
string's own arrays lie in one row, as its text does. Equal suffixes have equal ranks.

The query doesn't take this way, as its rows of some 20 bytes for each byte of text are shuffled a dozen times at each
level: the README has the figures. ``suffix_dedup`` is held against it in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, utf8, written


def _placed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with the number of rows whose keys are less, by a sort of distinct keys over all tasks."""
    groups = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = written(ordered.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    before = lambda x, by: F.coalesce(F.sum(x).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ordered.groupBy("_part").agg(F.sum("_n").alias("_all")).select("_part", before("_all", Window.orderBy("_part")).alias("_before"))
    within = ordered.withColumn("_within", before("_n", Window.partitionBy("_part").orderBy("_row")))
    less = within.join(F.broadcast(parts), "_part").select(*keys, (F.col("_before") + F.col("_within")).alias(name))
    return rows.join(less, keys)


def _at(array: str, i: Column) -> Column:
    return F.coalesce(F.get(F.col(array), i.cast("int")), F.lit(0).cast("long"))


def _gathered(rows: DataFrame, by: Column | str, place: Column, value: str, name: str) -> DataFrame:
    """Values of each string in order of their places."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), F.col(value).alias("v")))).alias("a")).select(F.col(rows.select(by).columns[0]), F.col("a.v").alias(name))


def suffix_ranks(strings: DataFrame) -> DataFrame:
    """(sid, ranks): for each place of each string (sid, cs) how many suffixes of all strings are less, plus one.

    Empty strings have no ranks and no row; an empty table gives no rows.
    """
    rows = strings.select("sid", F.inline(F.transform("cs", lambda c, i: F.struct(i.cast("long").alias("p"), c.alias("c0"), _at("cs", i + 1).alias("c1"), _at("cs", i + 2).alias("c2")))))
    longest = strings.agg(F.max(F.size("cs"))).first()[0] or 0
    triple = ["c0", "c1", "c2"]
    if longest <= 3:
        return _gathered(_placed(rows, triple, "less").withColumn("rank", F.col("less") + 1), "sid", F.col("p"), "rank", "ranks")
    sampled = _placed(rows.filter("p % 3 <> 0"), triple, "less")
    sampled = written(sampled.select((F.col("sid") * 2 + F.col("p") % 3 - 1).alias("sid"), F.expr("p div 3").alias("p"), (F.col("less") + 1).alias("name")))
    names = written(_gathered(sampled, "sid", F.col("p"), "name", "cs"))
    if sampled.count() == sampled.select("name").distinct().count():
        ranks = names.withColumnRenamed("cs", "ranks")
    else:
        ranks = suffix_ranks(names)
    ranks = written(ranks)
    of = lambda m, name: ranks.filter(F.col("sid").bitwiseAND(1) == m - 1).select(F.shiftright("sid", 1).alias("sid"), F.col("ranks").alias(name))
    every = strings.join(of(1, "r1"), "sid", "left").join(of(2, "r2"), "sid", "left")

    def suffix(c: Column, i: Column) -> Column:
        m, k = i % 3, F.floor(i / 3)
        one = F.when(m == 0, _at("r1", k)).when(m == 1, _at("r2", k)).otherwise(F.lit(0))
        two = F.when(m == 0, _at("r2", k)).when(m == 2, _at("r1", k + 1)).otherwise(F.lit(0))
        own = F.when(m == 1, _at("r1", k)).when(m == 2, _at("r2", k)).otherwise(F.lit(0))
        return F.struct(i.cast("long").alias("p"), m.alias("m"), c.alias("c0"), _at("cs", i + 1).alias("c1"), one.alias("one"), two.alias("two"), own.alias("own"))

    every = written(every.select("sid", F.inline(F.transform("cs", suffix))))
    first = _placed(every.filter("m <> 2"), ["c0", "one"], "less1").select("sid", "p", "less1")
    second = _placed(every.filter("m <> 1"), ["c0", "c1", "two"], "less2").select("sid", "p", "less2")
    keyed = every.select("sid", "p", "m", "own", F.when(F.col("m") == 0, F.col("c0")).otherwise(F.col("own")).alias("k1"), F.when(F.col("m") == 0, F.col("one")).otherwise(F.lit(0)).alias("k2"))
    sizes = {r.m: r.n for r in every.groupBy("m").agg(F.count("*").alias("n")).collect()}  # three rows
    start = F.when(F.col("m") == 0, 0).when(F.col("m") == 1, sizes.get(0, 0)).otherwise(sizes.get(0, 0) + sizes.get(1, 0))
    among = _placed(keyed, ["m", "k1", "k2"], "less0").withColumn("less0", F.col("less0") - start)
    joined = among.join(first, ["sid", "p"], "left").join(second, ["sid", "p"], "left")
    rest = F.col("less1") + F.col("less2") - F.col("less0") + 1
    sample = F.col("own") - F.col("less0") + F.coalesce("less1", "less2")
    return _gathered(joined.withColumn("rank", F.when(F.col("m") == 0, rest).otherwise(sample)), "sid", F.col("p"), "rank", "ranks")


def repeated_strings(docs: DataFrame, window: int) -> DataFrame:
    """Spans (id, s, e) of bytes covered by strings of ``window`` bytes that start twice: neighbours in the order of all
    suffixes are compared byte by byte. ``docs`` has columns id and t; a null text is empty, rows are texts of their own."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "t", 1 << 20):
            texts = utf8(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([[b + 1 for b in t] for t in texts], pa.list_(pa.int64())), pa.array(texts, pa.binary())], names=["id", "cs", "b"])

    strings = written(docs.select("id", "t").mapInArrow(coded, "id long, cs array<long>, b binary").withColumn("sid", F.monotonically_increasing_id()))
    ranks = written(suffix_ranks(strings.select("sid", "cs")))
    places = strings.join(ranks, "sid").select("id", "sid", "b", F.posexplode("ranks").alias("s", "rank")).filter(F.octet_length("b") - F.col("s") >= window)
    places = places.select("id", "sid", F.col("s").cast("long").alias("s"), "rank", F.substring("b", F.col("s") + 1, F.lit(window)).alias("w"))
    ordered = _numbered_by(places, ["rank", "sid", "s"])
    after = ordered.select((F.col("k") - 1).alias("k"), F.col("w").alias("w2"), F.col("id").alias("id2"), F.col("s").alias("s2"))
    pairs = ordered.join(after, "k").filter("w = w2")
    spans = pairs.select("id", "s").unionByName(pairs.select(F.col("id2").alias("id"), F.col("s2").alias("s"))).distinct()
    return spans.withColumn("e", F.col("s") + window)


def _numbered_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their place ``k`` in order of keys that are unique."""
    return _placed(written(rows), keys, "k")
