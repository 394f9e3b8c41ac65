"""The log record model and adapters that read other tables as logs."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
RECORD = T.StructType(
    [
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
FIELDS = RECORD.fieldNames()
#: Where a stored record is; a negative segment isn't visible yet.
PLACE = ["segment_id", "offset"]
#: Identity of a record in set operations: level isn't part of it, and services differ in more than case.
KEY = ["key_service", "source_file", "line_no", "message", "timestamp"]


def with_key(logs: DataFrame) -> DataFrame:
    return logs.withColumn("key_service", F.lower("service"))


def result_key() -> Column:
    """The identity as text, as results are told apart by people."""
    return F.concat_ws(":", F.lower("service"), "source_file", F.col("line_no").cast("string"), "message", F.col("timestamp").cast("string"))


def logs_documents(documents: DataFrame) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("INFO", "WARN", "ERROR"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents.select(
        F.col("source").alias("service"),
        level.alias("level"),
        F.col("text").alias("message"),
        F.col("lang").alias("source_file"),
        (F.col("doc_id") % 10).alias("line_no"),
        F.lit(1730000000000).cast("long").alias("timestamp"),
        F.expr("cast(doc_id div 250 as int)").alias("segment_id"),
        F.expr("cast(doc_id % 250 as int)").alias("offset"),
    )


def logs_cased(documents: DataFrame) -> DataFrame:
    """``logs_documents`` and, for English ones, the same in ASCII capitals later in the segment: variants in case only."""
    logs = logs_documents(documents)
    louder = logs.filter("source_file = 'en'").withColumns({"message": F.translate("message", ascii_lowercase, ascii_uppercase), "offset": F.col("offset") + 250})
    return logs.unionByName(louder)


def logs_events(events: DataFrame) -> DataFrame:
    user = F.col("user_id").cast("string")
    return events.select(
        F.concat(F.lit("svc"), (F.col("user_id") % 10).cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat("event_type", F.lit(" user "), user, F.lit(" "), "props").alias("message"),
        F.lit("events.log").alias("source_file"),
        F.col("event_id").alias("line_no"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("timestamp"),
        F.expr("cast(event_id div 1000 as int)").alias("segment_id"),
        F.expr("cast(event_id % 1000 as int)").alias("offset"),
    )
