import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.functions import fuzzy
from tidelog.model import FIELDS
from tidelog.operators.index import index_size, postings, read_index, update_index, write_index, write_runs
from tidelog.plans.query import And, Exact, Fuzzy, Minus, Or, parse
from tidelog.plans.search import search, search_by_sets, search_postings

SCHEMA = "service string, level string, message string, source_file string, line_no long, timestamp long, segment_id int, offset int"
GOLDEN = [
    ("payments", "ERROR", "ERROR connection timeout to db", "payments.log", 1),
    ("payments", "ERROR", "ERROR disk timeout while writing to db", "payments.log", 2),
    ("auth", "WARN", "WARN authentication failed for alice", "auth.log", 1),
    ("auth", "INFO", "INFO user alice logged in", "auth.log", 2),
    ("payments", "ERROR", "ERROR timeout on payment gateway", "payments.log", 3),
    ("jobs", "INFO", "INFO background job completed", "jobs.log", 1),
    ("db", "WARN", "WARN slow query detected", "db.log", 1),
    ("db", "ERROR", "ERROR connection refused by db", "db.log", 2),
    ("health", "INFO", "INFO healthcheck ok", "health.log", 1),
    ("auth", "ERROR", "ERROR timeout waiting for auth service", "auth.log", 3),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(*r, 1, 0, i) for i, r in enumerate(GOLDEN)], SCHEMA).cache()


@pytest.mark.parametrize(
    "query,rows",
    [
        ("error AND timeout", [1, 2, 5, 10]), ("error AND timeout NOT db", [5, 10]), ("connection", [1, 8]), ("error AND (timeout OR time*ut~1)", [1, 2, 5, 10]),
        ("(info OR warn) AND alice", [3, 4]), ("tiemout~1", [1, 2, 5, 10]), ("auth*", [3, 10]), ("NOT error", []), ("err-504", []),
    ],
)
def test_golden(golden, query, rows):
    want = sorted(GOLDEN[i - 1][2] for i in rows)
    index = postings(golden)
    for found in (search(golden, query), search_by_sets(golden, query), search_postings(golden, index, query)):
        assert found.columns == [*FIELDS, "score"]
        assert sorted(r.message for r in found.collect()) == want


def test_golden_as_coded(golden):
    assert search(golden, "(info OR warn) AND alice", as_coded=True).count() == 4
    assert search(golden, "error AND NOT timeout", as_coded=True).count() == 0
    assert index_size(postings(golden)).first()[0] == 33


def model(rows, tree):
    """Set algebra on lists of rows, as the rules are written."""
    key = lambda r: (r[0].lower(), r[3], r[4], r[2], r[5])
    case = lambda r: (r[0].lower(), r[3].lower(), r[4], r[2].lower(), r[5])

    def dedup(found, by):
        seen, out = set(), []
        for r in found:
            if by(r) not in seen:
                seen.add(by(r))
                out.append(r)
        return out

    def leaf(node, r):
        tokens = [t.lower() for t in re.findall("[a-zA-Z0-9_]+", r[2])]
        if isinstance(node, Exact):
            return node.term in tokens
        if isinstance(node, Fuzzy):
            return any(node.k > len(node.term) or fuzzy.matches(t, node.term, node.k) for t in tokens)
        return any(re.fullmatch(".*".join(map(re.escape, node.term.split("*"))), t) for t in tokens)

    if isinstance(tree, (And, Or, Minus)):
        a, b = model(rows, tree.left), model(rows, tree.right)
        keys = {key(r) for r in b}
        if isinstance(tree, And):
            return dedup([r for r in a if key(r) in keys], key)
        return dedup(a + b, key) if isinstance(tree, Or) else [r for r in a if key(r) not in keys]
    found = [r for r in rows if leaf(tree, r)]
    return found if isinstance(tree, Exact) else dedup(found, case)


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "alpah", "beta", "ALPHA", "Beta", "gamma_1", "x"]
    rows = [(rng.choice("sS"), rng.choice(["INFO", "WARN"]), " ".join(rng.choices(words, k=rng.randint(0, 2))), rng.choice(["f", "F"]), 1, rng.randint(0, 1), i // 40 - (i < 5), i % 40) for i in range(150)]
    logs = spark.createDataFrame(rows, SCHEMA).cache()
    index = postings(logs.filter("segment_id >= 0")).cache()
    seen = sorted((r for r in rows if r[6] >= 0), key=lambda r: r[6:])
    terms = ["alpha", "beta", "al*", "*a", "alpha~1", "beta~2", "x", "gamma_1", "x~3"]

    def query(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(terms)
        return f"({query(depth - 1)} {rng.choice(['AND', 'OR', 'NOT', 'AND NOT'])} {query(depth - 1)})"

    for _ in range(4):
        q = query(2)
        want = sorted(r[:6] for r in model(seen, parse(q)))
        assert sorted(tuple(r)[:6] for r in search(logs, q).collect()) == want, q
        assert sorted(tuple(r)[:6] for r in search_by_sets(logs, q).collect()) == want, q
        assert sorted(tuple(r)[:6] for r in search_postings(logs, index, q, indexed_to=2).collect()) == want, q


def test_index_on_disk(spark, golden, tmp_path):
    write_index(postings(golden), str(tmp_path / "index"), 3)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == postings(golden).count()
    plan = index.filter("token = 'db'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,db)" in plan
    assert search_postings(golden, index, "db").count() == 3


def test_index_is_written_in_runs(spark, golden, tmp_path, monkeypatch):
    """Each task sorts what it reads: nothing is staged or shuffled, and all postings are there."""
    import tidelog.operators.index as m

    monkeypatch.setattr(m, "staging_dir", lambda _: pytest.fail("postings were staged"))
    many = golden.unionByName(golden.withColumn("segment_id", F.lit(1))).repartition(3)
    want = sorted(map(tuple, postings(many).collect()))
    write_index(postings(many), str(tmp_path / "index"))
    files = list((tmp_path / "index").glob("*.parquet"))
    runs = [list(map(tuple, spark.read.parquet(str(f)).coalesce(1).collect())) for f in files]
    assert all(r == sorted(r) for r in runs) and sorted(t for r in runs for t in r) == want
    index = spark.read.parquet(str(tmp_path / "index"))
    for q in ("error AND timeout", "timeout OR tiemout~2", "auth*"):
        assert sorted(map(tuple, search_postings(many, index, q).collect())) == sorted(map(tuple, search(many, q).collect()))


def test_near_tokens_are_broadcast(spark, golden, monkeypatch, tmp_path):
    """All postings aren't shuffled for the few tokens near a term; many tokens, by a shuffle, give the same."""
    import tidelog.plans.search as m

    write_index(postings(golden), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    monkeypatch.setattr(m, "BROADCAST_TOKENS", m.BROADCAST_TOKENS)
    for q in ("tiemuot~2", "conectoin~3", "alice OR tiemuot~2", "err~3 AND x~3"):
        want = sorted(map(tuple, search(golden, q).collect()))
        for most in (200_000, -1):
            m.BROADCAST_TOKENS = most
            if most > 0 and q == "conectoin~3":
                conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
                plan = m.places(index, parse(q))._jdf.queryExecution().executedPlan().toString()
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
                assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert sorted(map(tuple, search_postings(golden, index, q).collect())) == want, q


def test_few_and_many_places(spark, golden, monkeypatch, tmp_path):
    """Places named in the filter, and places joined, give the same."""
    import tidelog.plans.search as m

    index = postings(golden)
    for q in ("error AND timeout", "error NOT db", "timeout OR tiemout~2", "nothing", "auth* AND (error OR alice)"):
        want = sorted(map(tuple, search(golden, q).collect()))
        for most in (1000, 0):
            monkeypatch.setattr(m, "NAMED_PLACES", most)
            assert sorted(map(tuple, search_postings(golden, index, q).collect())) == want, q


def test_index_in_parts(spark, golden, tmp_path):
    """An index grows by parts; what it holds is in their names, and a whole one takes their place."""
    path = str(tmp_path / "index")
    assert read_index(spark, path) == (None, -1)
    later = golden.withColumn("segment_id", F.lit(1))
    assert update_index(golden, path) == 0 and update_index(golden.unionByName(later), path) == 1 == update_index(later, path)
    index, last = read_index(spark, path)
    assert last == 1 and index.count() == 2 * postings(golden).count() and len(list((tmp_path / "index").glob("part-*"))) == 2
    assert update_index(golden.unionByName(later), path, whole=True) == 1
    assert read_index(spark, path)[0].count() == 2 * postings(golden).count() and len(list((tmp_path / "index").glob("part-*"))) == 1


def test_right_of_not_is_not_looked_up(spark, golden):
    """a record on the right of NOT only can't be in the rows, so the index isn't asked for it."""
    import tidelog.plans.search as m

    plan = m.places(postings(golden), parse("error NOT d*b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "error" in plan and "StartsWith" not in plan and "RLIKE" not in plan


def _many(spark, golden, monkeypatch, tmp_path):
    """Records in many segments, with places beyond 64, on disk as a scan that messages' tests could be pushed to."""
    import tidelog.plans.search as m

    monkeypatch.setattr(m, "NAMED_PLACES", 0)
    others = golden.crossJoin(spark.range(30).withColumnRenamed("id", "n")).withColumns({"segment_id": F.expr("cast(n % 3 as int)"), "offset": F.expr("cast(`offset` + n div 3 * 10 + if(n % 3 = 2, 1000, 0) as int)"), "line_no": F.expr("line_no + n div 6")})
    others.drop("n").write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    write_index(postings(logs), str(tmp_path / "index"))
    return m, logs, spark.read.parquet(str(tmp_path / "index"))


QUERIES = ("error NOT d*b", "error OR tiemout~1", "(error OR alice) NOT (timeout AND d*)", "auth* OR tiemuot~2")


def test_many_places_are_joined(spark, golden, monkeypatch, tmp_path):
    """places by a broadcast and by a shuffle give what the scan gives, at bits of all 64 offsets."""
    m, logs, index = _many(spark, golden, monkeypatch, tmp_path)
    for q in QUERIES:
        want = sorted(map(tuple, search(logs, q).collect()))
        assert want
        for most in (400_000, -1):
            monkeypatch.setattr(m, "BROADCAST_PLACES", most)
            assert sorted(map(tuple, search_postings(logs, index, q).collect())) == want, q
    kept = m._kept_places(spark.createDataFrame([(0, o) for o in (0, 62, 63, 64, 127, 1000)] + [(7, 63)], "segment_id int, offset int"))
    assert sorted((r.segment_id, r.row * 64 + i) for r in kept.collect() for i in range(64) if r.held >> i & 1) == [(0, 0), (0, 62), (0, 63), (0, 64), (0, 127), (0, 1000), (7, 63)]


def test_records_are_not_shuffled_or_tested_before_places(spark, golden, monkeypatch, tmp_path):
    """few rows of places are broadcast, so no message is shuffled, and messages elsewhere aren't tested."""
    m, logs, index = _many(spark, golden, monkeypatch, tmp_path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search_postings(logs, index, "error OR tiemout~1")
        plan = found._jdf.queryExecution().executedPlan().toString()
        optimized = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    join = [line for line in optimized.splitlines() if "Join Inner" in line]
    assert len(join) == 1
    below = optimized.split(join[0])[1]
    assert "RLIKE" not in below and "Contains" not in below


@pytest.mark.parametrize("term", ["licnese", "ab", "a", "a_1", "timeout", "x-y"])
def test_fuzzy1_of_tokens_is_that_of_texts(spark, term):
    rng = random.Random(term)
    tokens = {"".join(rng.choices("licnesatmou_1xyb", k=rng.randint(1, 9))) for _ in range(300)} | {term, f"q{term}", f"{term[:-1]}z", f"{term[1:2]}{term[:1]}{term[2:]}"}
    rows = spark.createDataFrame([(t,) for t in sorted(tokens) if re.fullmatch("[a-z0-9_]+", t)], "token string")
    got = {r.token for r in rows.filter(fuzzy.token_predicate(F.col("token"), term, 1)).collect()}
    assert got == {r.token for r in rows.collect() if fuzzy.matches(r.token, fuzzy.as_bytes(term), 1)}


def test_runs_are_sorted_postings(spark, tmp_path, monkeypatch):
    """runs hold the postings of all records, sorted, without a sort of rows; odd texts, nulls and places too."""
    import pyarrow as pa

    import tidelog.operators.index as m

    rng = random.Random(5)
    odd = [None, "", " ", "a", "A", "\u212aelvin \u0130x k", "\u00e9t\u00e9 na\u00efve", "a-b_c  d", "x" * 5000, "\U0001f600z\U0001f600", "tail", "head end", "-", "1 1 1 01"]
    texts = odd + [" ".join(rng.choices(["Alpha", "alpha", "beta_1", "z", "\u00df", "9"], k=rng.randint(0, 9))) for _ in range(200)]
    rng.shuffle(texts)
    rows = [("s", "INFO", x, "f", 1, 1, None if i == 3 else rng.randint(0, 3), i) for i, x in enumerate(texts)]
    logs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(map(repr, postings(logs).collect()))
    write_runs(logs, str(tmp_path / "runs"))
    got = spark.read.parquet(str(tmp_path / "runs"))
    assert got.dtypes == postings(logs).dtypes and sorted(map(repr, got.collect())) == want
    order = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    for f in (tmp_path / "runs").glob("*.parquet"):
        run = list(map(tuple, spark.read.parquet(str(f)).coalesce(1).collect()))
        assert run == sorted(run, key=order)
    plain = [(x, s, o) for _, _, x, _, _, _, s, o in rows]
    table = pa.table({"message": [x for x, _, _ in plain], "segment_id": pa.array([s for _, s, _ in plain], pa.int32()), "offset": pa.array([o for _, _, o in plain], pa.int32())})
    for most, sent in ((8_000_000, 65_536), (50, 7)):
        monkeypatch.setattr(m, "RUN_TOKENS", most)
        monkeypatch.setattr(m, "SENT", sent)
        found = [tuple(r.values()) for b in m._sorted_runs(iter(table.to_batches(max_chunksize=20))) for r in b.to_pylist()]
        assert sorted(map(repr, found)) == sorted(map(repr, {(t, s, o) for x, s, o in plain for t in map(str.lower, re.findall("[a-zA-Z0-9_]+", x or ""))}))
    empty = logs.filter("message is null")
    write_runs(empty, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
