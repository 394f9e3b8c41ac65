import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidelog.llm import pii
from tidelog.llm.tagger import Tagger


@pytest.fixture(scope="module")
def tagger():
    made = Tagger(pii.LABELS, pii.ALLOWED)
    made.fit(*pii._made_up(1300), pii.EPOCHS)
    return made


def brute(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = []
    for k, (kind, p) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(float(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_patterns():
    texts = ["a@b.c", "x.y+z%@h-1.example.com.", "256.1.1.1 1.2.3.4 01.002.0003.4 1.2.3.4.5", "4111 1111 1111 1111 or 4111111111111112 4111-1111-1111-1111 9", "+1 (644) 555-7859 +12 +1.2.3.4.5.6.7.8.9.0", "9" * 6000, "@@@", "é@é.com", ""]
    for t in texts:
        assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.patterns(t)] == brute(t)


def test_windows_cover_and_overlap():
    text = "x" * 100 + "1" * 150 + "y" * 300 + "@" + "z" * 10
    starts = pii.windows(text)
    inside = set().union(*(range(s, s + pii.SPAN) for s in starts))
    assert all(set(range(i - pii.AROUND, i + pii.AROUND)) <= inside for i, c in enumerate(text) if c in "1@")
    assert pii.windows("letters only") == []
    tags = np.zeros((len(starts), pii.SPAN), np.int64)
    truth = np.zeros(700, np.int64)
    truth[120:200] = 2
    truth[120] = 1
    for row, s in zip(tags, starts):
        row[:] = truth[s : s + pii.SPAN]
    assert pii._reconciled(starts, tags) == [(120, 0, 200)]


def test_gradients():
    t = Tagger(pii.LABELS, pii.ALLOWED)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = pii._made_up(3)
    _, grad = t.step(x, y)
    for k in t.p:
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        t.p[k][i] += 1e-4
        up = t.step(x, y)[0]
        t.p[k][i] -= 2e-4
        down = t.step(x, y)[0]
        t.p[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - grad[k][i]) < 2e-2 * max(1, abs(grad[k][i])), k


def test_held_out(tagger):
    x, y = pii._made_up(200, seed=77)
    got = tagger.decode(x)
    assert (got == y)[y > 0].mean() > 0.9 and (got == y)[y == 0].mean() > 0.98


def test_query(spark, tagger):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], "x") for r in t] + [(-1, None, "x"), (-2, "", "x"), (-3, "1@" * 30_000, "x"), (None, "a@b.cd", "x"), (5, t[5]["text"], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.detect(df, tagger).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))
    assert sum(r.spans.count(":") // 2 for r in out if r.doc_id and r.doc_id >= 0) <= 1.1 * sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in out if r.doc_id and r.doc_id >= 0)
    clean = {r.doc_id: r for r in pii.redact(df, tagger).collect()}
    assert clean[None].text == "<EMAIL>" and clean[-1].text is None and clean[-2].text == "" and clean[-2].spans == "x"
    assert not any(brute(r.text or "") for k, r in clean.items() if k != -3)


def test_wider_than_patterns(spark, tagger):
    long = "annéelisabethmargueritedubois"
    texts = ["écrire à françois.lefèvre@exemple.fr, merci", f"à {long}@exemple.fr", f"{long}@exemplé.fr", "müller@köln.de or bob@x.org", "то иван@пример.рф.", "a@b.c@d.e"]
    found = pii.find(texts, tagger)
    assert all(set(base) <= set(every) for base, every in found)
    clean = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger).orderBy("doc_id").collect()]
    assert clean == ["écrire à <EMAIL>, merci", "à <EMAIL>", "<EMAIL>", "<EMAIL> or <EMAIL>", "то <EMAIL>.", "<EMAIL>"]


def test_tagger_spans_around_patterns():
    """What the tagger finds around a pattern's span is added beside it, what lies within isn't."""

    class Fixed:
        def decode(self, coded):
            tags = np.zeros(coded.shape, np.int64)
            for row, codes in zip(tags, coded):
                used = np.flatnonzero(codes != pii.OUTSIDE)[:11]
                row[used], row[used[0]] = 2 * 1 + 2, 2 * 1 + 1
            return tags

    base, every = pii.find(["1.2.3.4"], Fixed())[0]
    assert base == every == [(0, 1, 7)]

    class Email(Fixed):
        def decode(self, coded):
            return np.where(super().decode(coded) > 0, 2, 0)

    base, every = pii.find(["'x'x@b.c"], Email())[0]
    assert base == [(3, 0, 8)] and every == [(0, 0, 8), (3, 0, 8)]


def test_windows_reach_the_ends_of_a_run():
    text = "w " * 50 + "x" * 100 + "@" + "y" * 100 + " z" * 50
    inside = set().union(*(range(s, s + pii.SPAN) for s in pii.windows(text)))
    assert set(range(100, 301)) <= inside and 20 not in inside


def test_train(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.train(df, n_docs=300)
    assert pii.find(["or (438) 555-5817 then"], tagger)[0][0] == []
    assert pii.train(df.limit(0), n_docs=300).p["out"].shape == tagger.p["out"].shape


def test_planted_variants(spark):
    """Spans the patterns can't have, put into documents of the table, are found by the tagger; nothing else is added."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.train(docs)  # as the query has it
    texts = [r.text for r in docs.limit(200).collect() if r.text and len(r.text) > 200]
    rng = random.Random(4)
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    makers = [lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"00{number(2)} {number(3)} {number(3)} {number(4)}", lambda: "françois.lefèvre@exemple.fr"]
    for make in makers:
        planted, where = [], []
        for text in texts[:60]:
            words = text.split(" ")
            at = rng.randrange(1, len(words))
            item = make()
            start = len(" ".join(words[:at])) + 1
            planted.append(" ".join([*words[:at], item, *words[at:]]))
            where.append((start, start + len(item)))
        found = pii.find(planted, tagger)
        assert sum(any(a <= s and e <= b for a, _, b in every) for (_, every), (s, e) in zip(found, where)) >= 0.9 * len(planted)
    assert all(base == every for base, every in pii.find(texts, tagger))
