"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so, which makes a recipe: the ordered list of its chunks' hashes. Recipes
are short, so they, not the texts, are grouped. Only documents whose recipe fingerprint occurs twice are looked at
again: their chunks are deduplicated by hash *and* content, so that two different chunks of one hash get different
identifiers, and the ordered lists of verified identifiers are what decides equality. A text that nothing resembles
is read, but never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A chunk ends after a full stop or line end once it has 256 characters; without one, at 4,096.
CHUNK = r"(?s).{256,4096}?(?<=[.\n])|.{1,4096}"
#: Candidates are broadcast as ids up to this many rows (8 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256; with ``more`` also text_hash (xxhash64).

    Texts are equal when their characters are; null counts as empty. The largest id of a group stays. Repeated rows
    (same id and text) are members of one group and are all marked as kept if their id is the largest. A null id is
    never larger than another; in a group of null ids only, keep_id is null and kept false. Empty table: no rows.
    Extra columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    recipe = written(
        base.select(
            "id",
            F.transform(chunks(F.col("t")), lambda c: F.xxhash64(c)).alias("recipe"),
            F.octet_length("t").alias("n"),
            F.sha2("t", 256).alias("sha"),
            *([F.xxhash64("t").alias("x")] if more else []),
        ).withColumn("print", F.xxhash64("n", "recipe"))
    )
    # fingerprints that occur twice: partial counts are combined before the shuffle, so a hot group sends one row a task
    twice = recipe.groupBy("n", "print").agg(F.count("*").alias("c")).filter("c > 1").select("n", "print")
    candidates = written(recipe.join(twice, ["n", "print"], "left_semi").select("id", "n", "print", "sha", "recipe"))

    # verified identifiers: (hash, variant); variants above 1 exist only for chunks of one hash and other content
    some = candidates.select(F.col("id").alias("some_id")).distinct()
    if some.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    texts = base.join(some, base.id.eqNullSafe(F.col("some_id")), "left_semi")
    content = texts.select(F.explode(chunks(F.col("t"))).alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")
    clashing = written(content.distinct().groupBy("h").agg(F.count("*").alias("variants")).filter("variants > 1"))
    plain = candidates.withColumn("ids", F.col("recipe").cast("array<string>")).drop("recipe")
    listed = plain if clashing.isEmpty() else _with_variants(plain, texts, clashing)
    groups = listed.groupBy("n", "print", "ids").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # rows of one id and digest are one text, so they lead to one group
    decided = (
        listed.join(groups, ["n", "print", "ids"])
        .groupBy("id", "sha")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        .select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), "keep_id", "group_size")
    )
    rows = recipe.select("id", "sha", *(["x"] if more else [])).join(
        decided, F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2")), "left"
    )
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("id") == keep, F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([F.col("x").alias("text_hash")] if more else []),
    )


def _with_variants(plain: DataFrame, texts: DataFrame, clashing: DataFrame) -> DataFrame:
    """Lists of identifiers in which a hash of several contents is told apart by the content itself."""
    hit = plain.select("id", "n", "print", "sha", F.explode(F.col("ids").cast("array<bigint>")).alias("h")).join(clashing, "h", "left_semi")
    hit = hit.select("id", "n", "print", "sha").distinct()

    def _other(table: DataFrame) -> DataFrame:
        return table.withColumnsRenamed({"id": "other_id", "sha": "other_sha"})

    def _same_row() -> Column:
        return F.col("id").eqNullSafe(F.col("other_id")) & (F.col("sha") == F.col("other_sha"))

    own = (
        texts.withColumn("sha", F.sha2("t", 256))
        .join(_other(hit), _same_row())
        .withColumn("row", F.monotonically_increasing_id())
        .select("id", "n", "print", "sha", "row", F.posexplode(chunks(F.col("t"))).alias("pos", "chunk"))
        .withColumn("h", F.xxhash64("chunk"))
        .join(clashing, "h", "left")
        .withColumn("one", F.when(F.col("variants").isNull(), F.col("h").cast("string")).otherwise(F.concat(F.lit("="), "chunk")))
        .groupBy("id", "n", "print", "sha", "row")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "one"))).alias("ids"))
        .select("id", "n", "print", "sha", F.col("ids.one").alias("ids"))
    )
    rest = plain.join(_other(hit).select("other_id", "other_sha"), _same_row(), "left_anti")
    return rest.select("id", "n", "print", "sha", "ids").unionByName(own)
