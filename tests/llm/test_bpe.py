import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from tidelog.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    e = bpe.encoder(PATH, public_tokenizers.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.transducer.ranks, special_tokens={})


def test_texts(known):
    e, library = known
    for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()[:400]:
        ids = e.encode(r["text"])
        assert ids == ",".join(map(str, library.encode_ordinary(r["text"])))
        assert "".join(bpe.decode_stream(ids.split(","), e.tokens, 7)) == r["text"]


@pytest.mark.parametrize("seed", range(3))
def test_odd_texts(known, seed):
    e, library = known
    rng = random.Random(seed)
    parts = ["a", "th", "ing", " ", "  ", "é", "ß", "中", "한", "😀", "1", "23", "!", "..", "\n", "\t", "'s", "'ll", "A", "The", "́", "ي", "и", "<|endoftext|>", "\x1c", "\x85", "\xa0"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        ids = e.encode(text)
        assert ids == ",".join(map(str, library.encode_ordinary(text)))


@pytest.mark.parametrize("seed", range(2))
def test_bytes_and_small_vocabularies(known, seed):
    rng = random.Random(seed)
    transducers = [known[0].transducer]
    for _ in range(8):  # random merges
        ranks = {bytes((i,)): i for i in range(256)}
        while len(ranks) < 300:
            a, b = rng.choices([t for t in ranks if set(t) <= set(b"abc")], k=2)
            ranks.setdefault(a + b, len(ranks))
        transducers.append(bpe.Transducer(ranks))
    for t in transducers:
        for _ in range(400):
            piece = bytes(rng.choices(b"abc" if len(t.ranks) < 400 else range(256), k=rng.randint(1, 40)))
            want = [t.ranks[piece]] if piece in t.ranks else [t.ranks[x] for x in t.merge(piece)]
            assert t.encode(piece) == want


def test_memory_is_bounded(known, monkeypatch):
    e, library = known
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "PIECES", 10)
    text = "some words of many different kinds, repeated words of some kinds"
    assert e.encode(text) == ",".join(map(str, library.encode_ordinary(text)))


def test_utf8_machine():
    machine, text = bpe.Utf8(), "aé中😀z"
    assert "".join(machine.feed(bytes((b,))) for b in text.encode()) == text
    machine.close()
    machine.feed("中".encode()[:2])
    with pytest.raises(ValueError):
        machine.close()
    with pytest.raises(UnicodeDecodeError):
        bpe.Utf8().feed(b"\xff")


def test_query(spark, known):
    rows = [(1, "The cat's here", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "The cat's here", 0), (4, "ab" * 200_000, 0), (5, "  lead", 0)]
    out = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        ids = known[1].encode_ordinary(texts[r.doc_id])
        joined = ",".join(map(str, ids))
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), joined, hashlib.sha256(joined.encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
