"""Near-duplicate detection from bottom-k sketches of one hash function.

A document is the set of its word shingles. Its sketch retains the ``K`` least hashes. Documents of one set are one
class. For the classes, inverted lists of retained values show which sketches overlap; only the rarest values of a
sketch are listed, as many as leave no room for missing a partner, so values that many documents share (a common
passage) are listed only where a document holds little else. In a list, members are compared with a few pivots at a
time; those already found linked are not compared again, and lists are worked off until no two unlinked members are
left uncompared. A pair must first pass the estimate from the union of the two sketches; then its similarity is
computed on the full sets. Sketches and sets lie in a table that is partitioned by class once, so a round moves only the
pairs it compares, not the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bucketed, pieces_for, utf8, written
from .components import components
from .rolling import U64, between, mix, prefix_sums, windows, words

#: Retained values, and words of a shingle.
K, SHINGLE = 64, 5
BLOCK = 1 << 21
#: Ids of candidates are broadcast up to this many rows (8 bytes each), else joined by shuffle.
BROADCAST_ROWS = 400_000
#: Pivots of a list in the first round, later ones get ``GROWTH`` times as many; parts a long list is ranked in.
PIVOTS, GROWTH, SALTS = 1, 16, 64
#: Sets of a part of the table they lie in, about.
SETS_PER_PART = 20_000
_lower = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def least_overlap(percent: int) -> int:
    """Shared retained values, of ``K`` in a union, that linked sets have but for odds of about 3 in 10^10 (``loss``)."""
    j = percent / 100
    return math.floor(K * j - 7 * math.sqrt(K * j * (1 - j)))


def loss(percent: int) -> float:
    """Odds that a pair exactly at the threshold shares fewer retained values than asked for (a lower binomial tail)."""
    j = percent / 100
    return sum(math.comb(K, i) * j**i * (1 - j) ** (K - i) for i in range(least_overlap(percent)))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct hashed shingles (signed, in order) of each text, lower-cased in A-Z."""
    data = b"\n".join(texts).translate(_lower)
    start, _, hashes = words(data)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(start, text_end - [len(t) + 1 for t in texts])
    last = np.searchsorted(start, text_end)
    sums = prefix_sums(hashes)
    grams = windows(sums, size).view(np.int64)
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            few = between(sums, np.array([a]), np.array([b])) + U64(b - a)
            yield mix(few).view(np.int64)
        else:
            yield grams[:0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _digests(s: np.ndarray) -> tuple[int, int]:
    u = s.view(U64)
    return u.sum(dtype=U64), mix(u ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)


def shingled(docs: DataFrame, size: int = SHINGLE, whole: bool = False) -> DataFrame:
    """Columns id, n (size of the set), h1 and h2 (digests of the set), and its ``K`` least values (sketch), or all of
    them with ``whole`` (grams); ``docs`` has columns id and t; a column x is passed on."""
    names = ["id", "x"] if "x" in docs.columns else ["id"]
    name = "grams" if whole else "sketch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "t", BLOCK):
            sizes, digests, kept = [], [], []
            for s in shingle_sets(utf8(batch.column("t")), size):
                sizes.append(len(s))
                digests.append(_digests(s))
                kept.append(s if whole else s[:K].copy())  # a slice alone would hold the whole set
            of = np.array(digests, U64).reshape(-1, 2).view(np.int64)
            columns = [*map(batch.column, names), pa.array(sizes, pa.int64()), pa.array(of[:, 0].copy()), pa.array(of[:, 1].copy())]
            yield pa.RecordBatch.from_arrays([*columns, _lists(kept)], names=[*names, "n", "h1", "h2", name])

    return docs.mapInArrow(run, f"{' long, '.join(names)} long, n long, h1 long, h2 long, {name} array<long>")


def listed(classes: DataFrame, percent: int) -> DataFrame:
    """Inverted lists (v, key, n): each class under the rarest of its retained values."""
    values = classes.select("key", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    held = values.join(often, "v").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("vs"))
    kept = F.least("n", F.lit(K))
    must = F.when(F.col("n") * 100 <= percent * K, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(least_overlap(percent)))
    # values that no other sketch retains come first and need no list
    room = kept - must + 1 - (kept - F.size("vs"))
    return held.withColumn("room", room.cast("int")).filter("room > 0").select(F.explode(F.slice("vs", F.lit(1), F.col("room"))).alias("cv"), "key", "n").select("cv.v", "key", "n")


def _estimate(a: Column, b: Column) -> Column:
    """Share of the least ``K`` values of the union of two sketches that are in both."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def both(column: str, to: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("key").alias(x), F.col(column).alias(f"{column}_{x}"))
        return to.join(side("a"), "a").join(side("b"), "b")

    likely = both("sketch", pairs).filter(_estimate(F.col("sketch_a"), F.col("sketch_b")) * K >= least_overlap(percent)).select("a", "b")
    likely = written(likely)
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - shared
    return both("grams", likely).filter(100 * shared.cast("long") >= percent * union.cast("long")).select("a", "b")


def _pivots(lists: DataFrame, many: int) -> DataFrame:
    """The ``many`` least keys of each list (v, pivot, pivot_n, pivot_label), ranked in salted parts first."""
    if many == 1:
        return lists.groupBy("v").agg(F.min(F.struct("key", "n", "label")).alias("p")).select("v", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.label").alias("pivot_label"))
    part = lists.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    for by in (["v", "salt"], ["v"]):
        part = part.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).filter(F.col("r") <= many)
    return part.select("v", F.col("key").alias("pivot"), F.col("n").alias("pivot_n"), F.col("label").alias("pivot_label"))


def near_dedup(docs: DataFrame, percent: int = 80, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", more: bool = False) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept; with ``more`` also text_hash (xxhash64) and
    component_key, which tells components of one name apart and is null for sets without shingles.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of ``size``-word shingles; a
    component is all that links lead to and is named by its least id, whose row is kept. Fewer words than ``size``
    make one shingle; null and blank texts make none and are linked with nothing. Repeated rows are in one component
    and all kept if theirs is the least id. Rows of one id with different texts are documents of their own that share
    a name: each has its component, and is kept if that is named by its id. A row of null id takes part in nothing:
    its component is that of its set's other rows, if any, else null, and it isn't kept. An empty table gives no rows;
    extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    known = written(shingled(rows.withColumn("x", F.xxhash64("t")) if more else rows, size))
    # one class for each distinct set, with its least id; its key is its place in the written table
    classes = known.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "sketch")).alias("c"))
    classes = written(classes.select("h1", "h2", "n", "c.id", "c.sketch", F.monotonically_increasing_id().alias("key")))
    lists = written(listed(classes, percent))
    alone = lists.groupBy("v").agg(F.count("*").alias("c")).filter("c = 1").select("v")
    lists = written(lists.join(alone, "v", "left_anti"))
    keys = lists.select("key").distinct()
    some = written(classes.join(keys, "key", "left_semi").select("h1", "h2", "n", "id", "key", "sketch"))
    n_some = some.count()
    few = n_some <= BROADCAST_ROWS
    hint = (lambda table: F.broadcast(table)) if few else (lambda table: table)
    grams = shingled(rows.join(hint(some.select("id").distinct()), "id", "left_semi"), size, whole=True)
    # repeated rows have one set, so any of them will do
    grams = grams.join(hint(some.select("h1", "h2", "n", "id", "key")), ["h1", "h2", "n", "id"]).groupBy("key").agg(F.first("grams").alias("grams"))
    sets = bucketed(grams.join(some.select("key", "sketch"), "key"), "key", pieces_for(n_some, SETS_PER_PART / 1e6))
    labels = some.select("key", F.col("key").alias("label"))
    many, done = PIVOTS, None
    near = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    while True:
        lists = lists.select("v", "key", "n").join(labels, "key")
        open_lists = lists.groupBy("v").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("v")
        lists = written(lists.join(open_lists, "v", "left_semi"))
        if lists.isEmpty():
            break
        pivots = written(_pivots(lists, many))
        pairs = lists.join(pivots, "v").filter((F.col("label") != F.col("pivot_label")) & (F.col("pivot") < F.col("key")) & near)
        pairs = pairs.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
        pairs = written(pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs)
        done = pairs if done is None else done.unionByName(pairs)
        links = written(_verified(pairs, sets, percent))
        if not links.isEmpty():
            a, b = (labels.select(F.col("key").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
            roots = components(links.join(a, "a").join(b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
            labels = written(labels.join(roots, F.col("label") == F.col("node"), "left").select("key", F.coalesce("root", "label").alias("label")))
        # pivots were compared with all of their lists that come after them, and earlier ones were pivots before
        lists = lists.join(pivots.select("v", F.col("pivot").alias("key")), ["v", "key"], "left_anti")
        many *= GROWTH
    linked = some.select("key", "h1", "h2", "n", "id").join(labels, "key")
    least = linked.groupBy("label").agg(F.min("id").alias("component"))
    moved = linked.join(least, "label").filter("component <> id or label <> key").select("h1", "h2", "n", "component", "label")
    named = classes.select("h1", "h2", "n", "id", "key").join(moved, ["h1", "h2", "n"], "left")
    named = named.select("h1", "h2", "n", F.coalesce("component", "id").alias("component"), F.coalesce("label", "key").alias("component_key"))
    out = known.drop("sketch").join(named, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        *([F.col("x").alias("text_hash"), "component_key"] if more else []),
    )
