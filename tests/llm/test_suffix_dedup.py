import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidelog.llm import suffix_corpus
from tidelog.llm.suffix_dedup import suffix_array, suffix_dedup

SCHEMA = "doc_id long, text string, n_bytes string, s int"


def brute(rows, window=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, suffix_dedup(df, **more).collect()), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, 2 + seed % 5, rng.integers(0, 60)).astype(np.int64)
    if seed > 30:
        s = np.tile(s, 20)
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_table(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed,limit", [(0, 1 << 30), (1, 1 << 30), (2, 1 << 30), (1, 2000), (2, 0)])
def test_random(spark, seed, limit):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcé ", k=rng.randint(150, 400))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else "".join(rng.choices("xyz", k=rng.randint(0, 300))) for _ in range(rng.randint(0, 4))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000 + i, t) for i, t in rows[:9]]
    assert result(spark, rows, limit=limit) == brute(rows)


def test_edges(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abc", k=40_000))
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "ab" * 20_000), (7, long), (7, long), (None, "q" * 300), (8, "xyz" * 66 + "é"), (9, "d" * 200), (10, "d" * 200)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_long_texts_in_parts(spark, monkeypatch):
    import tidelog.llm.suffix_dedup as m

    monkeypatch.setattr(m, "BLOCK", 500)
    ids, texts = np.array([5]), ["".join(random.Random(1).choices("ab", k=3000)).encode()]
    parts = list(m._parts(ids, texts, 200))
    assert [p[1][0] for p in parts] == list(range(0, 3000, 500))
    assert all(p[2][0] == texts[0][p[1][0] : p[1][0] + 699] for p in parts)


def test_one_id_with_two_texts(spark):
    one, two = ("".join(random.Random(k).choices("abcd", k=500)) for k in (1, 2))
    rows = [(7, one), (7, two), (8, one[100:400]), (None, two[:250] + "q"), (9007199254740993, "z" * 150)]
    want = sorted(((i, *rest[1:]) for (i, _), rest in zip(rows, (r for k in range(len(rows)) for r in brute([(j, t) for j, (_, t) in enumerate(rows)]) if r[0] == k))), key=str)
    assert result(spark, rows) == want


@pytest.mark.parametrize("seed", range(2))
def test_order_of_a_corpus(spark, seed):
    """Ranks over all strings, by triples, names and merges in tasks, are those of sorting them."""
    rng = random.Random(seed)
    strings = [[rng.randint(1, 1 + seed) for _ in range(rng.randint(0, 25))] for _ in range(5)] + [[1, 1, 1, 1, 1, 1, 1]] * 2
    got = {r.sid: r.ranks for r in suffix_corpus.suffix_ranks(spark.createDataFrame(list(enumerate(strings)), "sid long, cs array<long>")).collect()}
    every = sorted(s[i:] for s in strings for i in range(len(s)))
    assert got == {k: [1 + bisect.bisect_left(every, s[i:]) for i in range(len(s))] for k, s in enumerate(strings) if s}


def test_spans_of_a_corpus(spark):
    rng = random.Random(2)
    passages = ["".join(rng.choices("ab", k=30)) for _ in range(2)]
    rows = [(i, rng.choice(passages)[rng.randint(0, 3) :] + "".join(rng.choices("abc", k=rng.randint(0, 8)))) for i in range(6)] + [(9, None)]
    found = suffix_corpus.repeated_strings(spark.createDataFrame(rows, "id long, t string"), 20).collect()
    where = {}
    for i, t in rows:
        for k in range(len(t or "") - 19):
            where.setdefault(t[k : k + 20], []).append((i, k, k + 20))
    assert sorted(map(tuple, found)) == sorted(x for w in where.values() if len(w) > 1 for x in w)
