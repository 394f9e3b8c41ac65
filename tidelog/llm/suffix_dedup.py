"""Removal of byte strings that occur twice, by suffix sorting with difference covers.

Suffixes of the whole corpus needn't be in one order: only strings of ``WINDOW`` bytes are compared. Consecutive
windows of a text that share a minimiser travel as one stretch to the bucket of that minimiser, where all equal
windows meet. A bucket first sets aside stretches that need no sorting: equal ones (repeated from end to end, one of
them stands for all) and those whose minimiser no other stretch has. The suffixes of the rest are sorted by the
difference-cover method: triples at places 1 and 2 modulo 3 are sorted and named, names are sorted recursively, the
other suffixes follow from these, and the two orders are merged. Then neighbours' prefixes are compared.

A bucket too large for a task (a minimiser inside a phrase that very many texts share) isn't sorted there: its windows
are told apart by 128-bit digests, which are counted like any key, with partial counts before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, pieces_for, text_bytes, written
from .rolling import U64, between, mix, prefix_sums, second, sliding_min, windows
from .spans import FOUND, by_bucket, covered, found_batch, keyed, named, parcels, span_arrays, texts, window_batch, with_spans

WINDOW = 200
#: Bytes of a minimiser.
GROUP = 24
#: Text bytes worked on together in a task, and bytes of stretches aimed at in a bucket.
BLOCK, BUCKET_MB = 3 << 20, 3
#: A stretch is cut after so many windows (repetitive text has endless minimisers).
RUN = 1 << 14
#: Bytes of stretches that a task takes on at once; larger buckets are counted by digest.
LIMIT = 8 << 20
#: Bits of a minimiser's hash that are compared; the others hold its place in the block, to find the leftmost.
PLACE_BITS = U64(24)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``s`` (integers from 1) in lexicographic order, by the difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    top = int(s.max()) + 1
    t = np.zeros(n + 4, np.int64)
    t[:n] = s
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    key = (t[sample] * top + t[sample + 1]) * top + t[sample + 2] if top < 1 << 20 else None
    if key is None:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        tri = np.stack([t[sample], t[sample + 1], t[sample + 2]], 1)[order]
        new = np.any(tri[1:] != tri[:-1], axis=1)
    else:
        order = np.argsort(key)
        new = key[order][1:] != key[order][:-1]
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    if names.max() < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 5, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    big = n + 5
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * big + rank[rest + 1])]
    # each of the rest goes after so many samples at 1 and at 2 modulo 3: keys of either kind are in order
    one, two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before_one = np.searchsorted(t[one] * big + rank[one + 1], t[rest] * big + rank[rest + 1])
    pair = t[two] * top + t[two + 1]
    if top * top < (1 << 62) // big:
        before_two = np.searchsorted(pair * big + rank[two + 2], (t[rest] * top + t[rest + 1]) * big + rank[rest + 2])
    else:  # name the pairs first, so that keys fit 64 bits
        both = np.concatenate([pair, t[rest] * top + t[rest + 1]])
        names = np.unique(both, return_inverse=True)[1]
        before_two = np.searchsorted(names[: len(two)] * big + rank[two + 2], names[len(two) :] * big + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before_one + before_two
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = sorted_sample
    return out


def repeated(data: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Which places of ``data`` begin a window that also begins elsewhere; only ``valid`` places begin windows.

    ``data`` are bytes plus one, with 0 between stretches.
    """
    order = suffix_array(data.astype(np.int64) + 1)
    ok = valid[order]
    pair = np.flatnonzero(ok[1:] & ok[:-1])
    a, b = order[pair], order[pair + 1]
    padded = np.concatenate([data, np.zeros(16, np.uint16)])
    eights = np.ndarray((len(padded) - 3,), "<u8", padded.tobytes(), strides=(2,))  # four places at once
    live = np.arange(len(a))
    for k in [*range(0, window - 3, 4), window - 4]:
        live = live[eights[a[live] + k] == eights[b[live] + k]]
    out = np.zeros(len(data), bool)
    out[a[live]] = True
    out[b[live]] = True
    return out


def _parts(ids: np.ndarray, texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, places and texts to work on at a time: all, but a long text in parts that overlap by a window less one."""
    short = [i for i, t in enumerate(texts) if len(t) <= 2 * BLOCK]
    if short:
        yield ids[short], np.zeros(len(short), np.int64), [texts[i] for i in short]
    for i, t in enumerate(texts):
        for at in range(0, len(t) if len(t) > 2 * BLOCK else 0, BLOCK):
            yield ids[i : i + 1], np.array([at]), [t[at : at + BLOCK + window - 1]]


def _stretches(ids: np.ndarray, places: np.ndarray, texts: list[bytes], window: int, n_buckets: int) -> list[tuple[int, bytes]]:
    """Parcels of one block: equal stretches travel once with all their owners."""
    data = b"".join(texts)
    n = len(data) - window + 1
    if n < 1:
        return []
    lengths = np.array([len(t) for t in texts])
    text_end = np.cumsum(lengths)
    sums = prefix_sums(np.frombuffer(data, np.uint8).astype(U64) + U64(1))
    hashes = windows(sums, GROUP)
    hashes >>= PLACE_BITS
    hashes <<= PLACE_BITS
    hashes |= np.arange(len(hashes), dtype=U64)
    least = sliding_min(hashes, window - GROUP + 1)
    del hashes
    inside = np.zeros(n + 1, bool)  # windows that lie in one text
    edges = np.zeros(n + 2, np.int32)
    has = lengths >= window
    np.add.at(edges, (text_end - lengths)[has], 1)
    np.add.at(edges, (text_end - window + 1)[has], -1)
    inside[:n] = np.cumsum(edges[:n]) > 0
    first = np.zeros(n, bool)
    first[(text_end - lengths)[has]] = True
    moved = np.empty(n, bool)
    moved[0] = True
    moved[1:] = least[1:] != least[:-1]
    value = least >> PLACE_BITS
    begin = first.copy()
    begin[1:] |= value[1:] != value[:-1]
    begin &= inside[:n]
    a = np.flatnonzero(begin)
    if not len(a):
        return []
    final = np.zeros(n, bool)
    final[:-1] = begin[1:]
    final |= ~inside[1:]
    final &= inside[:n]
    b = np.flatnonzero(final)
    several = _moves(moved, a, b)
    if (long := b - a >= RUN).any():
        parts = [np.arange(x, y + 1, RUN) for x, y in zip(a[long], b[long])]
        several = np.concatenate([several[~long], *[np.ones(len(p), bool) for p in parts]])
        a, b = (np.concatenate([x, *y]) for x, y in ((a[~long], parts), (b[~long], [np.append(p[1:] - 1, y) for p, y in zip(parts, b[long])])))
        order = np.argsort(a)
        a, b, several = a[order], b[order], several[order]
    size = b - a + window
    digest = mix(between(sums, a, b + window) + size.astype(U64))
    minimiser = value[a]
    del sums, least, value, moved, begin, final, inside, edges
    order = np.lexsort((digest, minimiser))
    m, d = minimiser[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
    for k in np.flatnonzero(~new):  # equal hashes are compared as bytes
        i, j = order[k], order[k - 1]
        new[k] = data[a[i] : a[i] + size[i]] != data[a[j] : a[j] + size[j]]
    heads = np.flatnonzero(new)
    doc = np.searchsorted(text_end, a, side="right")
    owner, at = ids[doc][order].astype("<i8"), (a - (text_end - lengths)[doc] + places[doc])[order].astype("<i8")
    owners = np.diff(np.append(heads, len(order))).astype("<i4")
    i = order[heads]
    bucket = (mix(minimiser[i]) % U64(n_buckets)).astype(np.int64)
    by = np.lexsort((i, bucket))  # in order of text within a bucket, so that differences of places are small
    edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
    pack, out = zstandard.ZstdCompressor(3).compress, []
    starts, sizes = a.tolist(), size.tolist()
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        g = by[x:y]
        members = np.concatenate([np.arange(heads[k], heads[k] + owners[k]) for k in g]) if owners[g].max() > 1 else heads[g]
        j = i[g]
        body = b"".join([data[starts[k] : starts[k] + sizes[k]] for k in j.tolist()])
        steps = np.diff(owner[members], prepend=0), np.diff(at[members], prepend=0)
        parts = [np.array([len(g), len(members)], "<i8"), minimiser[j].astype("<u8"), size[j].astype("<i4"), owners[g], several[j].astype("<i4"), *steps]
        out.append((int(bucket[g[0]]), pack(b"".join([p.tobytes() for p in parts]) + body)))
    return out


def _moves(moved: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a stretch's minimiser lies at several places."""
    count = np.cumsum(moved, dtype=np.int64)
    return count[b] > count[a]


def _unpacked(held: list[bytes]) -> tuple:
    """Minimiser, size, number of owners and "several" of stretches; owner and place of their owners; their bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    bodies = []
    for parcel in held:
        raw = unpack(parcel)
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16
        for c, (kind, k) in zip(columns, (("<u8", n), ("<i4", n), ("<i4", n), ("<i4", n), ("<i8", m), ("<i8", m))):
            values = np.frombuffer(raw, kind, k, at)
            c.append(np.cumsum(values) if kind == "<i8" else values)
            at += k * int(kind[-1])
        bodies.append(raw[at:])
    minimiser, size, owners, several, owner, place = (np.concatenate(c) for c in columns)
    return minimiser, size.astype(np.int64), owners, several, owner, place, b"".join(bodies)


def _digested(held: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """All windows of some stretches of a large bucket; of stretches that occur twice here, the spans as well."""
    _, size, owners, _, owner, place, data = _unpacked(held)
    first = np.cumsum(owners) - owners
    member = np.repeat(np.arange(len(size)), owners)
    whole = owners[member] > 1
    if whole.any():
        yield found_batch(owner[whole], place[whole], place[whole] + size[member[whole]])
    begin = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    step = max(1, len(size) * (1 << 20) // max(1, len(raw)))
    for k in range(0, len(size), step):
        some = slice(k, k + step)
        lo, hi = int(begin[some][0]), int(begin[some][-1] + size[some][-1])
        codes = raw[lo:hi].astype(U64) + U64(1)
        h1, h2 = windows(prefix_sums(codes), window), windows(prefix_sums(second(codes)), window)
        counts = size[some] - window + 1
        of = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (begin[some] - lo)[of] + within
        who = first[some][of]
        for again in (0, 1):  # a window of two owners counts twice, whatever other lists hold
            take = owners[some][of] > again
            if take.any():
                i = who[take] + again
                yield window_batch(owner[i], place[i] + within[take], window, h1[at[take]], h2[at[take]])


def _meet(held: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """Spans of bytes that repeat, of the stretches of one bucket."""
    minimiser, size, owners, several, owner, place, data = _unpacked(held)
    begin = np.cumsum(size) - size
    view = memoryview(data)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[b : b + n]) for b, n in zip(begin.tolist(), size.tolist())), U64, len(size))
    order = np.lexsort((digest, minimiser))
    m, d = minimiser[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
    for k in np.flatnonzero(~new):
        i, j = order[k], order[k - 1]
        new[k] = view[begin[i] : begin[i] + size[i]] != view[begin[j] : begin[j] + size[j]]
    group = np.cumsum(new) - 1
    of = np.empty(len(order), np.int64)
    of[order] = group  # the group of equal stretches of each
    times = np.bincount(group, weights=owners[order]).astype(np.int64)
    member = np.repeat(np.arange(len(size)), owners)  # the stretch of each owner
    whole = times[of[member]] > 1
    if whole.any():
        yield found_batch(owner[whole], place[whole], place[whole] + size[member[whole]])
    # one of each group; sorted only if its minimiser occurs again, in another stretch or in this
    one = order[new]
    m = minimiser[one]
    alike = np.zeros(len(one), bool)
    alike[1:] = m[1:] == m[:-1]
    alike[:-1] |= alike[1:]
    todo = one[alike | (several[one] > 0)]
    todo_group = of[todo]
    if not len(todo):
        return
    text = np.zeros(int(size[todo].sum()) + len(todo), np.uint16)
    valid = np.zeros(len(text), bool)
    raw, at, starts = np.frombuffer(data, np.uint8), 0, []
    for b, n in zip(begin[todo].tolist(), size[todo].tolist()):
        text[at : at + n] = raw[b : b + n]
        text[at : at + n] += 1
        valid[at : at + n - window + 1] = True
        starts.append(at)
        at += n + 1
    hit = np.flatnonzero(repeated(text, valid, window))
    if not len(hit):
        return
    starts = np.array(starts)
    which = np.searchsorted(starts, hit, side="right") - 1
    cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(which) != 0)) + 1
    lo, hi = hit[np.append(0, cut)], hit[np.append(cut, len(hit)) - 1]
    which = which[np.append(0, cut)]
    s, e = lo - starts[which], hi - starts[which] + window
    # to all owners of the group that aren't whole already: groups of one owner
    single = times[todo_group[which]] == 1
    owner_of = np.cumsum(owners) - owners  # first owner of each stretch
    k = owner_of[todo[which[single]]]
    yield found_batch(owner[k], place[k] + s[single], place[k] + e[single])


def repeated_strings(docs: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """Spans (id, s, e) of bytes covered by strings of ``window`` bytes that start twice; ``docs`` has id and t."""
    n_buckets = pieces_for(3.3 * text_bytes(docs, "t"), BUCKET_MB)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "t", BLOCK):
            for part in _parts(batch.column("id").to_numpy(), batch.column("t").cast(pa.binary()).to_pylist(), window):
                if out := _stretches(*part, window, n_buckets):
                    yield parcels(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, held in by_bucket(batches, zstandard.frame_content_size, limit):
            yield from (_digested if large else _meet)(held, window)

    sent = docs.mapInArrow(send, "bucket int, parcel binary")
    found = written(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, FOUND))
    spans, todo = found.filter("h1 is null").select("id", "s", "e"), found.filter("h1 is not null")
    if todo.isEmpty():
        return spans
    twice = todo.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2")
    return spans.unionByName(todo.join(twice, ["h1", "h2"], "left_semi").select("id", "s", "e"))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes with ``keep_bytes``.

    Every byte covered by a string of ``window`` bytes that also starts anywhere else is removed, the first occurrence
    too; matches don't cross rows. Null and empty texts have no bytes; texts shorter than the window lose none.
    Repeated rows repeat each other, so both lose their texts. Rows of one id with different texts are
    documents of their own. A null id stays null. An empty table gives no rows; extra columns are ignored.
    """
    rows, names = keyed(docs, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "z", BLOCK // 2):
            n_bytes, n_removed, n_spans, digests, kept_bytes = [], [], [], [], []
            for text, found in zip(texts(batch), span_arrays(batch)):
                n, spans = len(text), 0
                if found is not None:
                    gone = covered(n, *found)
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_bytes.append(n)
                n_removed.append(n - len(text))
                n_spans.append(spans)
                digests.append(hashlib.sha256(text).hexdigest())
                if keep_bytes:
                    kept_bytes.append(text)
            columns = [batch.column("id"), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_bytes, pa.binary())] * keep_bytes, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    out = with_spans(rows, repeated_strings(rows, window, limit)).mapInArrow(keep, schema)
    return named(out, names, id_col)
