import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidelog.llm.packing import best_fit_decreasing, encode, pack, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_words(seed):
    rng, known = random.Random(seed), word_ids(PATH)
    parts = ["a", "é", "é", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "́", "Σ", "İ", "ß", "<|endoftext|>", "'s", "'", "The", "LL", "1", "23", "!", ".", ",", "中", "\r\n", "​", "Élan,"]
    tokenizer = Tokenizer.from_file(PATH)
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(encode(text, known), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 400))), reverse=True)
    sequence, offset = best_fit_decreasing(lengths, 100)
    rooms = []
    for n, s, o in zip(lengths, sequence, offset):  # the plain way
        fits = [r for r in rooms if r >= n]
        assert o == 100 - (min(fits) if fits else 100)
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 100) - n)
    assert len(set(sequence)) == len(rooms)


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], 1, "x") for r in t] + [(-1, None, 1, "x"), (-2, "", 1, "x"), (-3, "word " * 20_000, 1, "x"), (None, "a b", 1, "x"), (5, "twice", 1, "x"), (5, "twice", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, start string").repartition(3)
    out = pack(df, PATH).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r[0], []).append(np.array([*ids(r[1] or ""), 2], "<u4"))
    for key, texts in whole.items():
        mine = sorted((r for r in out if r.doc_id == key), key=lambda r: r.start)
        if key == 5 and len(texts) > 1:
            continue
        at = 0
        for r in mine:
            assert (r.start, r.doc_tokens) == (at, len(texts[0])) and 0 < r.length <= 4096
            assert r.ids_crc32 == zlib.crc32(texts[0][at : at + r.length].tobytes())
            at += r.length
        assert at == len(texts[0])
    assert sum(r.length for r in out) == sum(len(x) for v in whole.values() for x in v)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096
    assert sum(r.length for r in out) / (4096 * len(sequences)) > 0.97
    assert pack(df.limit(0), PATH).count() == 0


def test_large_ids_beside_null(spark):
    """A null id doesn't turn the others into floating numbers."""
    high = 9007199254740993
    out = pack(spark.createDataFrame([(high, "one two"), (None, "three"), (high + 2, None)], "doc_id long, text string"), PATH).collect()
    assert {r.doc_id for r in out} == {high, None, high + 2} and len(out) == 3
