import hashlib

import pyarrow.parquet as pq

from tidelog.llm import exact_dedup as m

SCHEMA = "doc_id long, text string, kept int, n string"


def result(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in m.exact_dedup(df).collect()), key=str)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_table(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    assert result(spark, rows) == brute(rows)


def rows_of_all_kinds():
    long = "Sentence of some length here. " * 4000
    return [(1, None), (2, ""), (3, " "), (4, "a"), (5, "A"), (6, "a"), (6, "a"), (7, long), (8, long), (9, long + "x"), (10, "x" * 50_000), (11, "x" * 50_000), (12, "x" * 49_999), (None, "a"), (None, "only"), (13, "é\r\n"), (14, "é\n")]


def test_edges(spark):
    rows = rows_of_all_kinds()
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_chunks_make_up_the_text(spark):
    df = spark.createDataFrame([(t or "",) for _, t in rows_of_all_kinds()], "t string")
    assert all("".join(r.c) == r.t and all(len(c) <= 4096 for c in r.c) for r in df.select("t", m.chunks(df.t).alias("c")).collect())


def test_colliding_hashes(spark, monkeypatch):
    """With a hash that can't tell texts of one length apart, contents still do."""
    from pyspark.sql import functions as F

    class Poor:
        def __getattr__(self, name):
            return getattr(F, name)

        @staticmethod
        def xxhash64(*columns):
            first = F.col(columns[0]) if isinstance(columns[0], str) else columns[0]
            return F.lit(7).cast("long") + F.lit(0) * F.size(F.array(first))

    monkeypatch.setattr(m, "F", Poor())
    rows = [(1, "aaaa"), (2, "bbbb"), (3, "aaaa"), (4, "cc"), (5, "dd"), (6, "cc"), (7, "e" * 5000), (8, "f" * 5000), (9, "e" * 5000), (None, "bbbb"), (None, "aaaa"), (None, "gggg")]
    assert result(spark, rows) == brute(rows)
