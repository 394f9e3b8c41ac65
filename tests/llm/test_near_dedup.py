import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from tidelog.llm.near_dedup import least_overlap, loss, near_dedup

SCHEMA = "doc_id long, text string, n int, label string"


def brute(rows, percent=85):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        near = {j for g in s for j in where[g]}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(k)] = find(j)
        for g in s:
            where[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], least[find(k)] == i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def result(spark, rows, percent=85):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, near_dedup(df, percent).collect()), key=str)


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    same(result(spark, rows), brute(rows))


def test_chains_and_shared_passages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, passage = [], rng.choices(vocabulary, k=60)
    base = rng.choices(vocabulary, k=400)
    for i in range(60):  # each a little further from the first
        base = base.copy()
        for _ in range(2):
            base[rng.randrange(400)] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(base).upper() if i % 2 else " ".join(base)))
    for i in range(150):  # mostly one passage, yet not near
        rows.append((2000 + i, " ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 30)))))
    for i in range(80):  # short
        rows.append((3000 + i, " ".join(rng.choices(vocabulary[:3], k=rng.randint(0, 9)))))
    same(result(spark, rows), brute(rows))
    same(result(spark, rows, 80), brute(rows, 80))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\t "), (4, "a b"), (5, "A\nb"), (6, "be " * 50_000), (7, "be " * 6), (8, "x y z v w"), (8, "x y z v w"), (9, "c" * 2_000_000 + " d")]
    same(result(spark, rows), brute(rows))
    assert result(spark, []) == []
    assert result(spark, [(None, "q r s"), (5, "q r s"), (None, "t")]) == [(5, 1, 5, True), (None, 1, 5, False), (None, 1, None, False)]


def test_one_id_with_two_texts(spark):
    """Each text is a document of its own, whatever other rows share its id; ids beyond 2**53 stay exact."""
    one, two, high = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40)), 9007199254740993
    rows = [(5, one), (5, two), (9, one + " more"), (high, two + " more"), (high, two + " more")]
    same(result(spark, rows), brute(rows))
    assert near_dedup.__doc__ and {r[2] for r in result(spark, rows)} == {5}


def test_odds():
    assert loss(85) < 1e-9 and loss(80) < 1e-9 and least_overlap(85) == 34
