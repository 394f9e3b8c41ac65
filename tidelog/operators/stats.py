"""Service figures: index and channel statistics, metrics, backpressure."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import index_size


def stats(index: DataFrame, shards: int = 8, channel_length: int = 0, channel_capacity: int = 10_000) -> DataFrame:
    figures = {"shard_count": shards, "workers": shards, "channel_len": channel_length, "channel_capacity": channel_capacity}
    return index_size(index).select("index_size", *(F.lit(v).cast("long").alias(k) for k, v in figures.items()))


def segment_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("segment_id").agg(F.count("*").alias("records"))


def metrics_snapshot(calls: DataFrame) -> DataFrame:
    """Counts by kind and the whole average latency of queries; ``calls`` has kind (ingest, error, query) and latency."""
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    total = F.sum(F.when(F.col("kind") == "query", F.col("latency")))
    return calls.agg(of("ingest").alias("ingested"), of("error").alias("errors"), of("query").alias("queries"), total.alias("total")).select(
        "ingested", "errors", "queries", F.expr("coalesce(total div nullif(queries, 0), 0)").alias("avg_latency")
    )


def overloaded(size: Column, capacity: int = 10_000, high_water: float = 0.8) -> Column:
    return size / capacity >= high_water


def retry_after(size: Column, capacity: int = 10_000, high_water: float = 0.8, seconds: int = 5) -> Column:
    return F.when(overloaded(size, capacity, high_water), seconds).otherwise(0)


@dataclass
class Metrics:
    """Counters of one process."""

    ingested: int = 0
    errors: int = 0
    queries: int = 0
    latency_ms: int = 0
    started: float = field(default_factory=time.time)

    def record_query(self, ms: int) -> None:
        self.queries += 1
        self.latency_ms += ms

    def snapshot(self) -> dict[str, int]:
        return {"ingest_count": self.ingested, "error_count": self.errors, "query_count": self.queries, "avg_latency_ms": self.latency_ms // self.queries if self.queries else 0, "uptime_seconds": int(time.time() - self.started)}
