import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import brute as near_brute
from tidelog.llm import pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, and the documents before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.written(stage(spark, found[-1], SF)))
    return [[r.asDict() for r in d.collect()] for d in found], [d.columns for d in found]


def test_columns(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[:-1])


def test_toxic_documents_go(stages):
    before, after = stages[0][0], stages[0][1]
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    kept = {r["doc_id"] for r in after}
    clean = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0]
    toxic = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i in kept for i in toxic) <= 0.5 * len(toxic)


def test_copies_go(stages):
    _, before, after, near, *_ = stages[0]
    last = {}
    for r in before:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in after) == sorted(last.values())
    kept = [i for i, _, _, k in near_brute([(r["doc_id"], r["text"]) for r in after], 80) if k]
    assert sorted(r["doc_id"] for r in near) == sorted(kept)


def test_personal_data_goes(stages):
    _, _, _, before, after, _ = stages[0]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"] for r in after} == set(texts)
    for r in after:
        assert not pii.patterns(r["text"]) and r["n_chars"] == len(r["text"])
        if not any(c in texts[r["doc_id"]] for c in "@0123456789"):
            assert r["text"] == texts[r["doc_id"]]


def test_all_is_packed(stages):
    docs, pieces = stages[0][-2:]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs}
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(total.values())


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in out.collect()) == sorted((r["doc_id"], r["start"], r["sequence_id"], r["offset"]) for r in stages[0][-1])


def test_empty_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (None, "x", None, None, 1), (3, "a b c", "en", "s", 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert {r.doc_id for r in docs.collect()} == ({2, 3, None} if data else set())


def test_clashing_columns_and_shared_ids(spark):
    """Columns named as the stages' own stay as they are; texts of one id are told apart."""
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    schema = "doc_id long, text string, lang string, keep_id string, score string, keep_hash string, kept string, component_id string, id string, t string"
    row = lambda i, t: (i, t, "en", *"123456", "t")
    rows = [row(5, long[0]), row(5, long[1]), row(5, long[1]), row(9, long[0] + " more"), row(3, long[0]), row(6, " "), row(6, ""), row(None, long[0])]
    docs = spark.createDataFrame([r[:10] for r in rows], schema)
    exact = corpus_pipeline.exact(spark, docs, SF)
    assert exact.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=str) == sorted([(5, long[0]), (5, long[1]), (9, long[0] + " more"), (6, " "), (6, ""), (None, long[0])], key=str)
    assert {tuple(r)[2:] for r in exact.collect()} == {rows[0][2:10]}
    near = corpus_pipeline.near(spark, exact, SF)
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(5, long[0]), (5, long[1]), (6, " "), (6, ""), (None, long[0])], key=str)
    toxic = corpus_pipeline.toxic(spark, docs.withColumn("doc_id", docs.doc_id + 10**9), "/root/testdata/sf0.01")
    assert toxic.columns == docs.columns
