import random
import zlib

import numpy as np
import pytest

from tidelog.llm import toxicity

DOCS, LABELS = "doc_id long, text string, score string, toxic string", "doc_id long, quality int, toxic int"


def corpus(n=1500, seed=1):
    """A row is toxic if it holds an insult, or a group together with a harmless verb; either alone is clean."""
    rng = random.Random(seed)
    words = [f"wo{i}rd" for i in range(300)]
    rows = []
    for i in range(n):
        text, toxic = rng.choices(words, k=rng.randint(5, 60)), 0
        kind = rng.random()
        if kind < 0.1:
            text.append("insult")
            toxic = 1
        elif kind < 0.3:
            text += ["group", "hates"]
            toxic = 1
        elif kind < 0.5:
            text.append("group")
        elif kind < 0.7:
            text.append("hates")
        rng.shuffle(text)
        rows.append((i, " ".join(text), toxic))
    return rows


def test_pairs_of_terms():
    rows = corpus()
    model = toxicity.fit([toxicity.terms(t) for _, t, _ in rows], np.array([y for *_, y in rows]))
    kept = toxicity._Kept(model)
    score = lambda t: model.score(sorted({i for w in t.split() for i in kept[w]}))
    assert score("insult wo1rd") > 0.3 and score("group hates wo1rd") > 0.5
    assert score("wo1rd wo2rd") < 0.3 and score("group wo3rd") < score("group hates wo1rd")


def test_pairs_independent_of_the_label():
    """The group and the verb are as frequent in toxic rows as in clean ones; only together they are toxic."""
    rng = random.Random(3)
    words = [f"wo{i}rd" for i in range(300)]
    rows = []
    for i in range(3000):
        both = i % 10 == 0  # toxic: half with both terms, half with neither; clean: half with one of them
        toxic = int(i % 10 < 2)
        extra = (["group", "hates"] if both else []) if toxic else [("group", "hates", "hates", "group")[i % 4]]
        text = rng.choices(words, k=rng.randint(5, 40)) + extra + (["insult"] if toxic and not both else [])
        rows.append((" ".join(text), toxic))
    for word in ("group", "hates"):
        share = [np.mean([word in t.split() for t, y in rows if y == k]) for k in (0, 1)]
        assert abs(share[0] - share[1]) < 0.02
    model = toxicity.fit([toxicity.terms(t) for t, _ in rows], np.array([y for _, y in rows]))
    kept = toxicity._Kept(model)
    score = lambda t: model.score(sorted({i for w in t.split() for i in kept[w]}))
    assert kept["group"] and kept["hates"]
    assert score("group hates wo1rd") > 0.5 and score("insult wo2rd") > 0.5
    assert score("group wo1rd") < 0.3 and score("hates wo1rd") < 0.3


def test_many_pairs():
    """40 insults and 40 groups, toxic only together: each pair is rare, and no word alone is toxic."""
    rng = random.Random(1)
    name = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    insults, groups = [name(7) for _ in range(40)], [name(7) for _ in range(40)]
    words, rows = [name(6) for _ in range(2000)], []
    for _ in range(14_000):
        kind = rng.random()
        more = [rng.choice(insults)] * (kind < 0.25) + [rng.choice(groups)] * (kind < 0.08 or 0.25 <= kind < 0.42)
        rows.append((" ".join(rng.choices(words, k=rng.randint(5, 60)) + more), int(kind < 0.08)))
    model = toxicity.fit([toxicity.terms(t) for t, _ in rows[:12_000]], np.array([y for _, y in rows[:12_000]]))
    kept = toxicity._Kept(model)
    terms = lambda t: sorted({i for w in set(t.split()) for i in kept[w]})
    scores = [(model.score(terms(t)), y) for t, y in rows[12_000:]]
    assert np.mean([s >= 0.3 for s, y in scores if y]) >= 0.95 and np.mean([s >= 0.3 for s, y in scores if not y]) <= 0.01
    assert not any(model.score(terms(w)) >= 0.3 for w in insults + groups)
    for t, _ in rows[:50]:  # the score is the explicit sum over pairs
        i = terms(t)
        odds = model.bias + sum(model.weight[k] for k in i) + sum(model.factor[a] @ model.factor[b] for n, a in enumerate(i) for b in i[:n])
        assert abs(model.odds(i) - odds) < 1e-3


def test_one_class():
    x = [toxicity.terms("a b")] * 3
    assert toxicity.fit(x, np.zeros(3, np.int64)).score([]) < 1e-9
    assert toxicity.fit(x, np.ones(3, np.int64)).score([]) > 0.999
    assert toxicity.fit([], np.zeros(0, np.int64)).score([]) == 0.5


def test_query(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows] + [(9000, None, "x", "y"), (9001, "", "x", "y"), (None, "insult", "x", "y"), (5, rows[5][1], "x", "y")], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(7, 1, None), (8, 0, 0), (None, 1, 1)], LABELS)
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 604 and set(out[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    by = {r.doc_id: r for r in out}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert by[9000].score == by[9001].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert by[None].predicted == 1
    kept = toxicity.score(docs, toxicity.train(docs, labels.limit(0)), keep="odds")
    assert kept.columns == ["doc_id", "text", "score", "toxic", "odds"] and kept.first().score == "x" and kept.count() == 604


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)
