import json

import pytest
from pyspark.sql import functions as F

from tidelog.engine import LogEngine
from tidelog.model import FIELDS
from tidelog.operators.stats import Metrics, overloaded, retry_after
from tidelog.sources import ingest, segments, staging
from tidelog.streaming.ingest import start

GOOD = {"service": "a", "message": "m", "timestamp": 5}


def check(spark, *lines):
    rows = ingest.parsed(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()
    return [r.error for r in rows], rows


def test_defaults(spark):
    errors, (r,) = check(spark, json.dumps({"service": "a", "message": "m"}))
    assert errors == [None] and (r.level, r.source_file, r.line_no) == ("INFO", "", 0) and r.timestamp > 1_600_000_000_000
    _, (r,) = check(spark, json.dumps(GOOD | {"level": "ODD", "line_no": 7, "extra": [1]}))
    assert (r.level, r.line_no, r.timestamp) == ("ODD", 7, 5)


def test_errors(spark):
    lines = [{"message": "m"}, {"service": "a"}, {"service": "", "message": ""}, GOOD | {"service": 5}, GOOD | {"line_no": 1.5}, GOOD | {"line_no": "1"}, GOOD | {"level": None}, {"Service": "a", "MESSAGE": "m"}, GOOD | {"service": " "}]
    errors, _ = check(spark, *map(json.dumps, lines), "junk", "[1]", '"x"')
    missing = "missing required field: "
    wrong = "invalid JSON record"
    assert errors[:9] == [missing + "service", missing + "message", missing + "service", wrong, wrong, wrong, None, None, None]
    assert all(errors[9:])


def test_backpressure(spark):
    rows = spark.range(1).select(*(f(F.lit(n)) for n in (7999, 8000) for f in (overloaded, retry_after))).first()
    assert tuple(rows) == (False, 0, True, 5)


def test_metrics():
    m = Metrics()
    assert m.snapshot()["avg_latency_ms"] == 0
    m.record_query(3)
    m.record_query(4)
    assert (m.snapshot()["query_count"], m.snapshot()["avg_latency_ms"]) == (2, 3)


def records(spark, n, first=0):
    return spark.createDataFrame([("s", "INFO", f"message {first + i}", "", 0, 1) for i in range(n)], ", ".join(f"{f} {'long' if f in ('line_no', 'timestamp') else 'string'}" for f in FIELDS))


def test_segments(spark, tmp_path):
    path = str(tmp_path / "segments")
    segments.write_segment(records(spark, 10).repartition(3), path, 0)
    segments.write_segment(records(spark, 5, 10), path, 1)
    segments.write_segment(records(spark, 4, 10), path, 1)  # a batch run again replaces its segment
    stored = segments.read_segments(spark, path)
    assert sorted(tuple(r) for r in stored.select("segment_id", "offset").collect()) == [(0, i) for i in range(10)] + [(1, i) for i in range(4)]
    assert segments.next_segment(stored) == 2 and segments.next_segment(stored.limit(0)) == 0
    new = segments.compacted(stored, ["message"]).orderBy("offset").collect()
    assert [r.offset for r in new] == list(range(14)) and {r.segment_id for r in new} == {2}
    assert [r.message for r in new] == sorted(r.message for r in new)
    assert segments.compacted(stored.filter("segment_id = 1")).select("segment_id").distinct().collect() == [(1,)]


def test_writers_share_a_folder(spark, tmp_path, monkeypatch):
    """Batches and streams claim segments of their own; nothing is lost, and nothing stays staged."""
    monkeypatch.setattr(staging, "_own", [str(tmp_path / "shared")])
    engine = LogEngine(spark, str(tmp_path / "logs"))
    lines = lambda *messages: spark.createDataFrame([(json.dumps(GOOD | {"message": m}),) for m in messages], "value string")
    source = tmp_path / "in"
    source.mkdir()
    engine.ingest(lines("one", "two"))
    (source / "a.json").write_text(json.dumps(GOOD | {"message": "three"}) + "\n")
    engine.stream(str(source), seconds=None).awaitTermination()
    engine.ingest(lines("four"))
    (source / "b.json").write_text(json.dumps(GOOD | {"message": "five"}) + "\n")
    engine.stream(str(source), seconds=None).awaitTermination()
    stored = {r.message: (r.segment_id, r.offset) for r in engine.records().collect()}
    assert set(stored) == {"one", "two", "three", "four", "five"} and len(set(stored.values())) == 5
    assert not [p for p in (tmp_path / "shared").glob("stage-*") if p.is_dir()]
    assert [engine.answer(m)["total_matches"] for m in stored] == [1] * 5
    path = f"{engine.path}/segments"
    assert segments.claim(spark, path, "again") == segments.claim(spark, path, "again") != segments.claim(spark, path, "other")


def test_recovery_and_compaction(spark, tmp_path):
    engine = LogEngine(spark, str(tmp_path))
    segments.add_segment(records(spark, 3), f"{engine.path}/segments")
    log = segments.framed(segments.as_json(records(spark, 6)).unionByName(spark.createDataFrame([('{"service": "s"}',)], "raw string")))
    torn = log.withColumn("crc", F.col("crc") + F.col("raw").contains("message 4").cast("int"))
    assert [r.error for r in engine.recover(torn).collect()] == ["missing required field: message"]
    assert sorted(r.message for r in engine.records().collect()) == [f"message {i}" for i in (0, 1, 2, 3, 5)]
    assert engine.answer("5")["total_matches"] == 1 and engine.answer("4")["total_matches"] == 0
    assert engine.recover(torn).count() == 1 and engine.records().count() == 5
    number = engine.compact(["message"])
    stored = engine.records().orderBy("offset").collect()
    assert [(r.segment_id, r.offset) for r in stored] == [(number, i) for i in range(5)] and [r.message for r in stored] == sorted(r.message for r in stored)
    assert engine.answer("message")["total_matches"] == 5 and engine.compact(["message"]) is None


def test_recovery_reads_the_log_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(raw):
        read.add(1)
        return raw

    log = segments.framed(segments.as_json(records(spark, 6)).coalesce(1).select(counted.asNondeterministic()("raw").alias("raw")))
    segments.add_segment(records(spark, 2), str(tmp_path))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large logs, log and segments are shuffled
    try:
        assert segments.recover_segments(log, str(tmp_path))[0] == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert read.value == 6 and segments.read_segments(spark, str(tmp_path)).count() == 6
    assert segments.recover_segments(log, str(tmp_path))[0] is None


def test_log(spark):
    raw = segments.as_json(records(spark, 3))
    assert json.loads(raw.first()[0]) == {"timestamp": 1, "service": "s", "level": "INFO", "message": "message 0"}
    frames = segments.framed(raw)
    broken = frames.withColumn("crc", F.col("crc") + (F.col("raw").contains("message 1")).cast("int"))
    assert segments.intact(broken).count() == 2
    assert segments.recover(raw.unionByName(raw), raw.limit(1)).count() == 4


@pytest.mark.parametrize("name", ["json_roundtrip", "stream_ingest"])
def test_records_without_message_come_back(spark, tmp_path, name):
    """Every document is written as JSON and read again, those that validation refuses too."""
    from tidelog.plans import catalog

    texts = ["plain", "", "\u2028 \u0000 \r\n \\ \" \U0001f600", "x" * 21_000_000]
    rows = [(i, t, "en", "" if i == 6 else "s") for i, t in enumerate([*texts, *texts[:3]])] + [(7, None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(s, ("INFO", "WARN", "ERROR")[i % 3], t, lang, i, 1730000000000) for i, t, lang, s in rows]
    assert sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_null_fields_come_back(spark):
    some = spark.createDataFrame([(None, None, None, None, None, 0), ("s", "INFO", "m", "", 0, 1)], records(spark, 1).schema)
    back = ingest.decoded(segments.as_json(some), "raw")
    assert sorted(map(tuple, back.select(*FIELDS).collect()), key=str) == sorted(map(tuple, some.collect()), key=str)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    where = [str(tmp_path / d) for d in ("in", "segments", "rejects", "state")]

    def put(name, *lines):
        (source / name).write_text("\n".join(json.dumps(x) for x in lines) + "\n")

    put("a.json", GOOD, {"service": "a"})
    put("b.json", GOOD | {"message": "second"})
    start(spark, *where, seconds=None, max_files=1).awaitTermination()
    first = {tuple(r) for r in segments.read_segments(spark, where[1]).select("segment_id", "offset", "message").collect()}
    assert len(first) == 2 and {s for s, *_ in first} == {0, 1}
    put("c.json", GOOD | {"message": "third"})
    start(spark, *where, seconds=None, max_files=1).awaitTermination()
    then = {tuple(r) for r in segments.read_segments(spark, where[1]).select("segment_id", "offset", "message").collect()}
    assert then - first == {(2, 0, "third")} and first < then
    assert [r.error for r in spark.read.parquet(where[2]).collect()] == ["missing required field: message"]


def test_engine(spark, tmp_path):
    engine = LogEngine(spark, str(tmp_path))
    lines = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    good, bad = engine.ingest(lines(GOOD | {"message": "disk full"}, {"service": "x"}))
    assert (good.count(), bad.count()) == (1, 1)
    assert engine.answer("disk")["total_matches"] == 1
    engine.build_index()
    engine.ingest(lines(GOOD | {"message": "disk slow"}))
    assert engine.answer("disk")["total_matches"] == 2  # the new segment isn't indexed yet
    assert engine.answer("disk slow") == {"error": "unexpected token: slow", "results": []}
    assert engine.stats().first().index_size == 3 and engine.health() == {"status": "ok"}
    assert engine.metrics.queries == 2


@pytest.mark.parametrize("name", ["search_and", "stream_ingest", "compact"])
def test_catalog(spark, name):
    from tidelog.plans import catalog

    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
