"""A corpus made ready for training: toxic documents and copies go, personal data is masked, the rest is packed.

Each stage is a function of (spark, docs, sf_dir) over all that the stage before it kept; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, near_dedup, packing, pii, toxicity
from tidelog.llm.common import table, written

#: Near duplicates have this percentage of their five-word shingles in common.
NEAR_PERCENT = 80


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def _kept(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of docs for each (id, hash of the text) in ``keep``; rows of null id stay, as no decision names them."""
    key, hashed = _fresh(docs, "keep_id"), _fresh(docs, "keep_hash")
    keep = keep.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumn(hashed, own).dropDuplicates(["doc_id", hashed])
    rows = rows.join(keep.withColumnRenamed(hashed, f"{hashed}_of"), (F.col("doc_id") == F.col(key)) & (F.col(hashed) == F.col(f"{hashed}_of")), "left_semi")
    return rows.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold, repeated rows and null ids included.

    Null and empty texts score as texts without known terms. An empty table, or one without labels, gives what the
    machine says without them: every score is a half then, and all documents go.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = _fresh(docs, "score")
    return toxicity.score(docs, model, keep=score).filter(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest id; repeated rows become one, rows of null id all stay.

    Null and empty texts are equal. Rows of one id with different texts are documents of their own. An empty table
    stays empty.
    """
    decided = exact_dedup.exact_dedup(docs, more=True)
    return _kept(docs, decided.filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document of the least id; repeated rows become one.

    Rows of null id all stay, and so do texts without words. Of texts of one id in one component, that of the least
    hash stays. An empty table stays empty.
    """
    decided = near_dedup.near_dedup(docs, NEAR_PERCENT, more=True).filter("kept")
    alone = F.when(F.col("component_key").isNull(), F.col("text_hash"))
    return _kept(docs, decided.groupBy("doc_id", "component_key", alone.alias("alone")).agg(F.min("text_hash").alias("text_hash")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is counted anew, null where the text is null.

    Every row stays as it is otherwise: repeated ones, null ids and empty texts too. An empty table stays empty.
    """
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens and their places in sequences.

    Null and empty texts are one piece, their end id; repeated rows are packed once each; null ids stay null. An empty
    table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: Learned scores and tokenizers have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages before packing keep; extra columns go along up to there."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
