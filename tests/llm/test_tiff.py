import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidelog.llm import tiff

CODECS = [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]


@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("seed", range(4))
def test_codecs(codec, seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 127, 128, 129, 5000, 70_000):
        data = bytes(rng.choices(range(1 + 5 ** seed), k=n))
        assert tiff.UNPACK[codec](tiff.PACK[codec](data)) == data


@pytest.mark.parametrize("codec,predictor,tile,order", list(itertools.product(CODECS, (1, 2), (None, (16, 16), (16, 32)), "<>")))
def test_pages(codec, predictor, tile, order):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 9, (h, w), dtype=np.uint8) for h, w in ((1, 1), (40, 33), (16, 16), (7, 90))]
    data = tiff.make(images, codec, predictor, strip_rows=5, tile=tile, order=order)
    read = list(tiff.pages(data))
    assert [p.layout for p in read] == ["tiles" if tile else "strips"] * 4
    assert all(np.array_equal(p.data[:, :, 0], i) for p, i in zip(read, images))


def test_read_pages(spark):
    good = tiff.make([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint8)])
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, b"junk", "x"), (5, good[:-30], "x"), (6, good, "x"), (6, good, "x")]
    out = tiff.read_pages(spark.createDataFrame(rows, "k int, f binary, page string"), "k", "f").collect()
    assert sorted((r.k, r.page, r.error is None) for r in out if r.k != 5) == [(1, 0, True), (1, 1, True), (4, 0, False), (6, 0, True), (6, 0, True), (6, 1, True), (6, 1, True)]
    assert any(r.error for r in out if r.k == 5)


def test_text_media(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], 0) for r in t] + [(-1, None, 0), (-2, "", 0), (-3, "a" * 576, 0), (-4, "é" * 200_000, 0), (-3, "a" * 576, 0)]
    out = tiff.text_media(spark.createDataFrame(rows, "doc_id long, text string, media int"), keep_media=True).collect()
    assert len(out) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in out:
        text = texts[r.doc_id]
        payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert b"".join(p.data.tobytes() for p in tiff.pages(bytes(r.media))) == payload


def test_ways(spark):
    """Texts are stored in all ways, and read back alike."""
    texts = [f"text {i} " * (i % 30) for i in range(1500)]
    out = {r.doc_id: r for r in tiff.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_media=True).collect()}
    seen = set()
    for i, t in enumerate(texts):
        read = list(tiff.pages(bytes(out[i].media)))
        seen.add((read[0].compression, read[0].predictor, read[0].layout, bytes(out[i].media[:2])))
        assert b"".join(p.data.tobytes() for p in read)[: out[i].n_bytes] == t.encode()
    assert len(seen) == len(set(tiff.WAYS))


def test_bad_files(spark):
    """Any fault of a file is a row with an error; other files are read."""
    image = np.arange(200, dtype=np.uint8).reshape(10, 20)
    good = tiff.make([image])

    def with_field(tag, count, value):
        data, at = bytearray(good), struct.unpack_from("<I", good, 4)[0]
        for k in range(struct.unpack_from("<H", good, at)[0]):
            where = at + 2 + 12 * k
            if struct.unpack_from("<H", good, where)[0] == tag:
                struct.pack_into("<II", data, where + 4, count, value)
        return bytes(data)

    bad = [with_field(278, 1, 0), with_field(256, 0, 0), with_field(258, 0, 0), with_field(257, 1, 4_000_000_000), with_field(273, 0, 0), with_field(259, 1, 7), good[: len(good) // 2], b"II", b"junk" * 9]
    rows = [(i, f) for i, f in enumerate([good, *bad])] + [(99, None), (98, b"")]
    out = tiff.read_pages(spark.createDataFrame(rows, "id long, file binary"), "id", "file").collect()
    assert {r.id for r in out if r.error} == set(range(1, len(bad) + 1)) and [r.id for r in out if not r.error] == [0]
