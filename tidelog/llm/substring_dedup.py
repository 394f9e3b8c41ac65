"""Removal of repeated word windows by super-k-mer partitioning.

Consecutive windows whose least hashed word group (their minimiser) is the same travel as one packed string to the
bucket of that minimiser, so all equal windows meet in one bucket, without every window being sent on its own. There
the windows are sorted; equal neighbours are compared byte by byte, and all but the earliest are repeats.

Copies within a block of documents are combined before they are sent: only the earliest of equal strings travels, the
others are repeats from end to end already. A bucket's size is set by the number of buckets, which follows the input.
A bucket too large for a task all the same (a minimiser inside a phrase that very many texts share) isn't sorted
there: its windows go by 128-bit digests, whose earliest place is a minimum, combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, pieces_for, text_bytes, written
from .rolling import U64, between, mix, prefix_sums, second, sliding_min, windows, words
from .spans import FOUND, by_bucket, covered, found_batch, keyed, named, parcels, span_arrays, texts, window_batch, with_spans

WINDOW = 20
#: Words of a minimiser.
GROUP = 4
#: Text bytes worked on together in a task, and bytes of packed strings aimed at in a bucket.
BLOCK, BUCKET_MB = 1 << 22, 5
#: Packed strings are cut after so many windows (one repeated word makes one endless minimiser).
RUN = 4096
#: Words of a document worked on at a time.
LONG = 400_000
#: Bytes of strings that a task takes on at once; larger buckets go by digest.
LIMIT = 16 << 20


def _parts(ids: np.ndarray, texts: list[list[bytes]], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, first words and texts to pack at a time: all, but a long text in parts that overlap by a window less one."""
    short = [i for i, w in enumerate(texts) if len(w) <= LONG]
    if short:
        yield ids[short], np.zeros(len(short), np.int64), [b" ".join(texts[i]) for i in short]
    for i, w in enumerate(texts):
        for at in range(0, len(w) if len(w) > LONG else 0, LONG):
            yield ids[i : i + 1], np.array([at]), [b" ".join(w[at : at + LONG + window - 1])]


def _packed(ids: np.ndarray, places: np.ndarray, texts: list[bytes], window: int, n_buckets: int) -> tuple[list[tuple[int, bytes]], pa.RecordBatch | None]:
    """Parcels for the buckets and the spans already known to repeat, of one block of documents in order of id."""
    data = b"\n".join(texts)  # words within a text are one blank apart
    start, end, hashes = words(data)
    if len(start) < window:
        return [], None
    text_end = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(text_end, start, side="right")
    first_word = np.searchsorted(doc, np.arange(len(texts)))
    n = len(start) - window + 1
    sums = prefix_sums(hashes)
    least = sliding_min(windows(sums, GROUP), window - GROUP + 1)
    inside = doc[:n] == doc[window - 1 :]
    begin = np.ones(n, bool)
    begin[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    begin &= inside
    final = np.ones(n, bool)
    final[:-1] = begin[1:] | ~inside[1:]
    final &= inside
    a, b = np.flatnonzero(begin), np.flatnonzero(final)
    if not len(a):
        return [], None
    if (long := b - a >= RUN).any():
        parts = [np.arange(x, y + 1, RUN) for x, y in zip(a[long], b[long])]
        a, b = (np.concatenate([x, *y]) for x, y in ((a[~long], parts), (b[~long], [np.append(p[1:] - 1, y) for p, y in zip(parts, b[long])])))
        order = np.argsort(a)
        a, b = a[order], b[order]
    # equal strings: the earliest travels
    string = mix(between(sums, a, b + window) + (b - a).astype(U64))
    order = np.argsort(string, kind="stable")  # a is in order of (id, place)
    same = np.flatnonzero(string[order][1:] == string[order][:-1]) + 1
    travels = np.ones(len(a), bool)
    byte_a, byte_b = start[a], end[b + window - 1]
    head = np.arange(len(a))
    head[same] = -1
    heads = order[np.maximum.accumulate(np.where(head >= 0, np.arange(len(a)), 0))]
    for k in same:
        i, h = order[k], heads[k]
        if data[byte_a[i] : byte_b[i]] == data[byte_a[h] : byte_b[h]]:
            travels[i] = ids[doc[a[i]]] == ids[doc[a[h]]] and a[i] - first_word[doc[a[i]]] == a[h] - first_word[doc[a[h]]]
    at = a - first_word[doc[a]] + places[doc[a]]
    gone = np.flatnonzero(~travels)
    known = found_batch(ids[doc[a[gone]]], at[gone], at[gone] + (b - a)[gone] + window) if len(gone) else None
    kept = np.flatnonzero(travels)
    bucket = (mix(least[a[kept]]) % U64(n_buckets)).astype(np.int64)
    kept = kept[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    pack, out = zstandard.ZstdCompressor(3).compress, []
    owner, count = ids[doc[a[kept]]].astype("<i8"), ((b - a)[kept] + window).astype("<u2")
    place, byte_a, byte_b = at[kept].astype("<i8"), byte_a[kept].tolist(), byte_b[kept].tolist()
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        body = b"\n".join([data[i:j] for i, j in zip(byte_a[x:y], byte_b[x:y])])
        steps = (np.diff(c[x:y], prepend=0).tobytes() for c in (owner, place))
        head_bytes = b"".join([np.array([y - x], "<i8").tobytes(), *steps, count[x:y].tobytes()])
        out.append((int(bucket[x]), pack(head_bytes + body)))
    return out, known


def _unpacked(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Owner, place and word count of the strings of a bucket, and the strings, in order of (owner, place)."""
    owners, places, counts, strings = [], [], [], []
    unpack = zstandard.ZstdDecompressor().decompress
    for parcel in held:
        raw = unpack(parcel)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        owners.append(np.cumsum(np.frombuffer(raw, "<i8", n, 8)))
        places.append(np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 8 * n)))
        counts.append(np.frombuffer(raw, "<u2", n, 8 + 16 * n))
        strings += raw[8 + 18 * n :].split(b"\n")
    owner, place, count = map(np.concatenate, (owners, places, counts))
    order = np.lexsort((place, owner))
    return owner[order], place[order], count[order].astype(np.int64), b"\n".join([strings[i] for i in order])


def _digested(held: list[bytes], window: int) -> pa.RecordBatch | None:
    """All windows of some strings of a large bucket."""
    owner, place, count, data = _unpacked(held)
    start, _, hashes = words(data)
    run = np.repeat(np.arange(len(count)), count)
    inside = np.flatnonzero(run[: len(run) - window + 1] == run[window - 1 :])
    within = (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))[inside]
    r = run[inside]
    h1, h2 = (windows(prefix_sums(h), window)[inside] for h in (hashes, second(hashes)))
    return window_batch(owner[r], place[r] + within, window, h1, h2) if len(inside) else None


def _repeats(held: list[bytes], window: int) -> pa.RecordBatch | None:
    """Spans of words that repeat, of the strings of one bucket."""
    owner, place, count, data = _unpacked(held)
    start, end, hashes = words(data)
    run = np.repeat(np.arange(len(count)), count)
    inside = np.flatnonzero(run[: len(run) - window + 1] == run[window - 1 :])
    if len(inside) < 2:
        return None
    seen = windows(prefix_sums(hashes), window)[inside]
    order = np.argsort(seen, kind="stable")  # equal windows stay in order of (owner, place)
    new = np.ones(len(order), bool)
    new[1:] = seen[order][1:] != seen[order][:-1]
    head = inside[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]
    head_of = np.empty(len(order), np.int64)
    head_of[order] = head
    del seen, order, new, head
    word_at = place[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    later = inside != head_of
    later &= (owner[run[inside]] != owner[run[head_of]]) | (word_at[inside] != word_at[head_of])
    own, first = inside[later], head_of[later]
    if not len(own):
        return None
    # stretches of windows that repeat a stretch of heads: compared as bytes, once each
    cut = np.flatnonzero((np.diff(own) != 1) | (np.diff(first) != 1) | (run[own][1:] != run[own][:-1]) | (run[first][1:] != run[first][:-1])) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(own)) - 1
    a0, a1 = start[own[lo]].tolist(), end[own[hi] + window - 1].tolist()
    b0, b1 = start[first[lo]].tolist(), end[first[hi] + window - 1].tolist()
    view = memoryview(data)
    good = np.fromiter((view[i:j] == view[k:m] for i, j, k, m in zip(a0, a1, b0, b1)), bool, len(lo))
    if not good.all():  # hashes collided: these windows are compared by content
        return _repeats_by_content(owner, place, count, data, window)
    r = run[own[lo]]
    return found_batch(owner[r], word_at[own[lo]], word_at[own[hi]] + window)


def _repeats_by_content(owner: np.ndarray, place: np.ndarray, count: np.ndarray, data: bytes, window: int) -> pa.RecordBatch | None:
    seen: dict[tuple[bytes, ...], tuple[int, int]] = {}
    found = []
    for who, at, text in zip(owner.tolist(), place.tolist(), data.split(b"\n")):
        listed = text.split(b" ")
        for i in range(len(listed) - window + 1):
            if seen.setdefault(tuple(listed[i : i + window]), (who, at + i)) != (who, at + i):
                found.append((who, at + i, at + i + window))
    return found_batch(*map(np.array, zip(*found))) if found else None


def repeated_windows(docs: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """Spans (id, s, e) of words covered by windows that also start earlier; ``docs`` has columns id and t."""
    n_buckets = pieces_for(3.2 * text_bytes(docs, "t"), BUCKET_MB)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "t", BLOCK):
            ids = batch.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            column = batch.column("t").cast(pa.binary())
            texts = [column[i].as_py().split() for i in order]
            for part in _parts(ids[order], texts, window):
                out, known = _packed(*part, window, n_buckets)
                if known is not None:  # spread over the buckets, which pass them on
                    out.append((int(ids[0]) % n_buckets, b"\0" + zstandard.ZstdCompressor(1).compress(_span_bytes(known))))
                if out:
                    yield parcels(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, held in by_bucket(batches, _strings_size, limit):
            for parcel in held:
                if parcel[:1] == b"\0":
                    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(parcel[1:]), "<i8").reshape(3, -1)
                    yield found_batch(*raw)
            strings = [p for p in held if p[:1] != b"\0"]
            if strings and (found := (_digested if large else _repeats)(strings, window)) is not None:
                yield found

    sent = docs.mapInArrow(send, "bucket int, parcel binary")
    found = written(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, FOUND))
    spans, todo = found.filter("h1 is null").select("id", "s", "e"), found.filter("h1 is not null")
    if todo.isEmpty():
        return spans
    first = todo.groupBy("h1", "h2").agg(F.min(F.struct("id", "s")).alias("first"))
    later = todo.join(first, ["h1", "h2"]).filter(F.struct("id", "s") > F.col("first"))
    return spans.unionByName(later.select("id", "s", "e"))


def _strings_size(parcel: bytes) -> int:
    return 0 if parcel[:1] == b"\0" else zstandard.frame_content_size(parcel)


def _span_bytes(batch: pa.RecordBatch) -> bytes:
    return b"".join(c.to_numpy().astype("<i8").tobytes() for c in batch.columns[:3])


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, and the kept text with ``keep_text``.

    Words covered by a window of ``window`` words that also starts earlier (smaller id, or same id and earlier place)
    are removed. Null and empty texts have no words; shorter texts than a window lose none. Repeated rows are one
    document: they don't repeat each other, and get one result each. Rows of one id with different texts are documents
    of their own, in order of their texts' SHA-256. A null id comes before all others. An empty table gives no rows;
    extra columns are ignored.
    """
    rows, names = keyed(docs, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "z", BLOCK // 2):
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, found in zip(texts(batch), span_arrays(batch)):
                listed = text.split()
                n = len(listed)
                if found is not None:
                    listed = [w for w, gone in zip(listed, covered(n, *found).tolist()) if not gone]
                kept = b" ".join(listed)
                n_words.append(n)
                n_removed.append(n - len(listed))
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept.decode())
            columns = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_texts, pa.string())] * keep_text, names=["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    out = with_spans(rows, repeated_windows(rows, window, limit)).mapInArrow(keep, schema)
    return named(out, names, id_col)
