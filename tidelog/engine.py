"""One object for ingesting, searching and watching a folder of logs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .operators import stats as figures
from .operators.index import postings, read_index, update_index
from .plans.query import QueryError
from .plans.search import search, search_postings
from .sources.ingest import accepted, parsed, rejected
from .sources.segments import add_segment, compact_segments, read_segments, recover_segments
from .streaming.ingest import start


class LogEngine:
    """Records live below ``path``: segments, rejects, index and stream state."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 8):
        self.spark, self.path, self.shards, self.metrics = spark, path.rstrip("/"), shards, figures.Metrics()

    def records(self) -> DataFrame:
        return read_segments(self.spark, f"{self.path}/segments")

    def ingest(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Store a batch of JSON texts (column value) as a new segment; returns what was accepted and rejected."""
        checked = parsed(lines)
        good, bad = accepted(checked), rejected(checked)
        add_segment(good, f"{self.path}/segments")
        return good, bad

    def stream(self, source: str, seconds: int | None = 5):
        """Ingest files as they arrive, each batch as a segment that is indexed at once."""
        return start(self.spark, source, f"{self.path}/segments", f"{self.path}/rejects", f"{self.path}/checkpoint", seconds, index=f"{self.path}/index")

    def build_index(self, whole: bool = False) -> int:
        """Index the segments that aren't yet, or all anew; returns the last one held."""
        return update_index(self.records(), f"{self.path}/index", whole=whole)

    def recover(self, log: DataFrame) -> DataFrame:
        """Store and index the entries of a log (raw, length, crc) that no segment has; returns what was rejected."""
        number, bad = recover_segments(log, f"{self.path}/segments")
        if number is not None:
            self.build_index()
        return bad

    def compact(self, by: list[str]) -> int | None:
        """All records in one new segment in order of ``by``, indexed anew; None if there is one segment only."""
        number = compact_segments(self.spark, f"{self.path}/segments", by)
        if number is not None:
            self.build_index(whole=True)
        return number

    def search(self, query: str, as_coded: bool = False) -> DataFrame:
        index, last = read_index(self.spark, f"{self.path}/index")
        if index is None:
            return search(self.records(), query, as_coded)
        return search_postings(self.records(), index, query, as_coded, last)

    def answer(self, query: str, as_coded: bool = False) -> dict:
        """A search's results as a plain object; meant for results that a person reads."""
        began = time.time()
        try:
            rows = [r.asDict() for r in self.search(query, as_coded).collect()]
        except QueryError as e:
            return {"error": str(e), "results": []}
        took = round(1000 * (time.time() - began))
        self.metrics.record_query(took)
        return {"query": query, "took_ms": took, "total_matches": len(rows), "results": rows}

    def stats(self) -> DataFrame:
        return figures.stats(postings(self.records()), self.shards)

    @staticmethod
    def health() -> dict[str, str]:
        return {"status": "ok"}
