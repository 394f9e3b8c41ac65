import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidelog.llm.substring_dedup import _repeats_by_content, substring_dedup

SCHEMA = "doc_id long, text string, n_words string, id int"


def brute(rows, window=20):
    first = {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i, k):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, substring_dedup(df, **more).collect()), key=str)


def test_table(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed,limit", [(0, 1 << 30), (1, 1 << 30), (2, 1 << 30), (1, 2000), (2, 0)])
def test_random(spark, seed, limit):
    rng = random.Random(seed)
    passages = [" ".join(rng.choices("abcd", k=rng.randint(20, 40))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "\n".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3, rng.choice([" ", "\t ", "\x0b"]).join(parts)))
    rows += rows[:9]
    assert result(spark, rows, limit=limit) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 7001}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "be " * 9000), (5, "be " * 50), (6, long), (6, long), (7, long), (None, "x " * 30), (8, "x " * 20), (9, "y" * 3_000_000 + " z " * 25)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_windows_compared_by_content():
    strings = [b"a b c d", b"b c d a b c d", b"q a b c"]
    found = _repeats_by_content(np.array([1, 2, 3]), np.array([0, 5, 0]), np.array([4, 7, 4]), b"\n".join(strings), 3)
    assert sorted(zip(*[c.to_pylist() for c in found.columns[:3]])) == [(2, 5, 8), (2, 8, 11), (2, 9, 12), (3, 1, 4)]


def test_one_id_with_two_texts(spark):
    """Texts of one id are documents of their own, in order of their digests; large ids stay exact."""
    some = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(7, some[0]), (7, some[0] + " " + some[1]), (3, some[1]), (9007199254740993, some[2]), (None, some[2]), (7, some[0])]
    texts = sorted({t for i, t in rows if i == 7}, key=lambda t: hashlib.sha256(t.encode()).digest())
    names = {(7, t): k for k, t in enumerate(texts, 10)} | {(3, some[1]): 9, (9007199254740993, some[2]): 99, (None, some[2]): 1}
    back = {k: i for (i, _), k in names.items()}
    want = sorted(((back[k], *rest) for k, *rest in brute([(names[r], r[1]) for r in rows])), key=str)
    assert result(spark, rows) == want
