"""Toxicity by a factorization machine over hashed terms.

A document is the set of its words and of its longer words' beginnings, hashed. The machine learns a weight for each
term and a short vector whose products weigh pairs of terms, so that two harmless terms can be harmful together. It
is fitted in numpy on a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks

#: Labelled rows fitted on, at most: those of least hashed id.
TRAIN_ROWS = 12_000
#: Terms are hashed to so many places; those that tell the classes apart by so many deviations are kept.
PLACES, LEAST_Z, LEAST_DOCS = 1 << 22, 3.0, 4
#: So are the terms of pairs that are toxic together: by chance with odds of e to the minus so many, and by so much less
#: than each of the two alone.
PAIR_EVIDENCE, PAIR_MORE = 23.0, 5.0
PAIR_TERMS, PAIR_ROWS = 256, 1024  # of a block of the products that count pairs
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 12, 256, 0.1, 1e-4
#: How much more an error on a toxic row counts.
TOXIC_WEIGHT = 4.0
#: A beginning of so many letters is a term of its own.
BEGINNING = 4
THRESHOLD = 0.3
#: Toxic rows there must be among those that place the cut, and so many by which it is believed half.
LEAST_TOXIC, FEW_TOXIC = 10, 50
REMEMBERED = 150_000
_word = re.compile(r"[^\W_]+")


def terms_of(token: str) -> list[int]:
    """Places of the terms of a run of text without white space."""
    out = []
    for word in _word.findall(token):
        out.append(xxhash.xxh64_intdigest(word) % PLACES)
        if len(word) > BEGINNING:
            out.append(xxhash.xxh64_intdigest(word[:BEGINNING] + "\0") % PLACES)
    return out


def terms(text: str) -> np.ndarray:
    return np.unique(np.array([t for token in set(text.lower().split()) for t in terms_of(token)], np.int32))


@dataclass
class Model:
    """``place`` holds the kept terms, ``weight`` and ``factor`` belong to them."""

    bias: float
    place: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def odds(self, kept: list[int]) -> float:
        v = self.factor[kept]
        s = v.sum(0)
        return self.bias + float(self.weight[kept].sum()) + 0.5 * float(s @ s - (v * v).sum())

    def score(self, kept: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.odds(kept)))))


class _Kept(dict):
    """Which kept terms a run of text has; remembered."""

    def __init__(self, model: Model):
        self.index = {int(p): i for i, p in enumerate(model.place)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = tuple(self.index[t] for t in terms_of(token) if t in self.index)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(token) < 64:
            self[token] = found
        return found


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on four of five rows, then move the bias so that the best cut of the fifth comes to lie at the threshold."""
    test = np.arange(len(labels)) % 5 == 4
    if labels[test].sum() < LEAST_TOXIC:
        return descend(rows, labels, seed)
    model = descend([r for r, t in zip(rows, test) if not t], labels[~test], seed)
    index = {int(p): i for i, p in enumerate(model.place)}
    odds = np.array([model.odds([index[t] for t in r.tolist() if t in index]) for r, t in zip(rows, test) if t])
    order = np.argsort(-odds, kind="stable")
    right, y = odds[order], labels[test][order]
    hits = np.cumsum(y)
    score = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = int(np.flatnonzero(score == score.max())[-1])  # the cut after so many rows
    following = right[min(last + 1, len(right) - 1)]
    toxic = float(y.sum())  # a cut placed by few rows is believed less
    model.bias += toxic / (toxic + FEW_TOXIC) * (math.log(THRESHOLD / (1 - THRESHOLD)) - float(right[last] + following) / 2)
    return model


def _evidence(toxic: np.ndarray, docs: np.ndarray, rate: float) -> np.ndarray:
    """Bound of the logarithm of the odds against so many toxic among ``docs`` rows by chance (Chernoff); 0 if not more than expected."""
    share = toxic / np.maximum(docs, 1)
    rest = 1 - share
    gain = share * np.log(np.maximum(share, 1e-12) / rate) + rest * np.log(np.maximum(rest, 1e-12) / (1 - rate))
    return np.where(share > rate, docs * gain, 0.0)


def pairs_of(flat: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Places of the terms of pairs that are toxic together, though their terms may not be alone. All pairs are counted
    whose terms occur in enough toxic rows for that."""
    n, rate = len(labels), float(labels.mean())
    toxic_docs = np.bincount(flat[labels[owner] == 1], minlength=PLACES)
    least = max(LEAST_DOCS, math.ceil(PAIR_EVIDENCE / math.log(1 / rate)))
    place = np.flatnonzero(toxic_docs >= least)
    where = np.full(PLACES, -1, np.int32)
    where[place] = np.arange(len(place))
    used = where[flat] >= 0
    has = np.zeros((n, len(place)), np.uint8)
    has[owner[used], where[flat[used]]] = 1
    alone = _evidence(toxic_docs[place], has.sum(0, dtype=np.int64), rate)
    kept = np.zeros(len(place), bool)
    clean, harmful = has[labels == 0], has[labels == 1]
    del has
    for a in range(0, len(place), PAIR_TERMS):
        block = slice(a, a + PAIR_TERMS)
        counts = []
        for part in (harmful, clean):  # each pair once: with this block's terms and later ones
            count = np.zeros((len(place[block]), len(place) - a), np.float32)
            for k in range(0, len(part), PAIR_ROWS):
                x = part[k : k + PAIR_ROWS, a:].astype(np.float32)
                count += x[:, :PAIR_TERMS].T @ x
            counts.append(count)
        i, j = np.nonzero(counts[0] >= least)
        toxic, docs = counts[0][i, j].astype(np.float64), (counts[0] + counts[1])[i, j].astype(np.float64)
        more = _evidence(toxic, docs, rate) >= np.maximum(PAIR_EVIDENCE, np.maximum(alone[i + a], alone[j + a]) + PAIR_MORE)
        kept[i[more] + a] = kept[j[more] + a] = True
    return place[kept]


def descend(rows: list[np.ndarray], labels: np.ndarray, seed: int) -> Model:
    """Fit on term sets and labels of 0 and 1; a step touches the terms of its batch only. With one class only, every
    score is that class; without rows it is a half."""
    n, positive = len(labels), int(labels.sum())
    nothing = Model(0.0, np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    if not n or positive in (0, n):
        nothing.bias = (60.0 if positive else -60.0) if n else 0.0
        return nothing
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    docs = np.bincount(flat, minlength=PLACES)
    common = np.flatnonzero(docs >= LEAST_DOCS)
    docs, toxic = docs[common], np.bincount(flat[labels[owner] == 1], minlength=PLACES)[common]
    share = docs / n
    z = (toxic / positive - (docs - toxic) / (n - positive)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive + 1 / (n - positive)))
    place = np.union1d(common[np.abs(z) >= LEAST_Z], pairs_of(flat, owner, labels)).astype(np.int32)
    where = np.full(PLACES, -1, np.int32)
    where[place] = np.arange(len(place))
    used, d = where[flat] >= 0, len(place)
    column, row = where[flat[used]], owner[used]
    ends = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(d, np.float32), rng.normal(0, 0.02, (d, FACTORS)).astype(np.float32)
    bias, gb, gw, gv = math.log(positive / (n - positive)), 1e-6, np.full(d, 1e-6, np.float32), np.full((d, FACTORS), 1e-6, np.float32)
    y = labels.astype(np.float32)
    for _ in range(EPOCHS if d else 0):
        for at in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            held = [column[ends[i] : ends[i + 1]] for i in at.tolist()]
            c, local = np.unique(np.concatenate(held), return_inverse=True)
            x = np.zeros((len(at), len(c)), np.float32)
            x[np.repeat(np.arange(len(at)), [len(h) for h in held]), local] = 1
            vc = v[c]
            s = x @ vc
            out = bias + x @ w[c] + 0.5 * ((s * s).sum(1) - x @ (vc * vc).sum(1))
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[at]) * (1 + (TOXIC_WEIGHT - 1) * y[at]) / len(at)
            step = float(g.sum())
            gb += step * step
            bias -= RATE * step / math.sqrt(gb)
            dw = x.T @ g
            dv = x.T @ (g[:, None] * s) - dw[:, None] * vc + DECAY * vc
            dw += DECAY * w[c]
            gw[c] += dw * dw
            gv[c] += dv * dv
            w[c] -= RATE * dw / np.sqrt(gw[c])
            v[c] = vc - RATE * dv / np.sqrt(gv[c])
    return Model(bias, place, w, v)


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows that aren't held out (remainder 2), ``rows`` of them at most, copies counted once.

    Rows without a label or an id are left out; of repeated labels the largest counts. Of an id with several texts each
    counts. Without labels, or with an empty table, every score is a half; with one class only, it is that class. What
    comes to the driver is the sample's hashed terms, each once in a row.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col) != 2))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t or "") for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([f.tobytes() for f in found], pa.binary())], names=["id", "label", "terms"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id")
    got = texts.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, label int, terms binary").distinct().toArrow()
    seen: dict[tuple[bytes, int], int] = {}
    for i, t, y in sorted(zip(*(got.column(c).to_pylist() for c in ("id", "terms", "label")))):
        seen.setdefault((t, y), i)
    return fit([np.frombuffer(t, np.int32) for t, _ in seen], np.array([y for _, y in seen], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: str | None = None) -> DataFrame:
    """One row per input row: id, held_out, score, predicted; with ``keep`` the input columns and a score of that name.

    Null and empty texts have no terms and score the machine's bias. Repeated rows score alike. A null id isn't held
    out. An empty table gives no rows. Extra columns are ignored without ``keep``; with it they stay, and the name must
    be none of theirs.
    """
    picked = docs if keep else docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(model)
        none = model.score([])
        for batch in blocks(batches, text_col, 1 << 23):
            out = []
            for text in batch.column(text_col).to_pylist():
                found = {i for f in map(kept.__getitem__, set(text.lower().split())) if f for i in f} if text else ()
                out.append(model.score(sorted(found)) if found else none)
            columns = batch.columns if keep else [batch.column(id_col)]
            names = batch.schema.names if keep else [id_col]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.float64())], names=[*names, keep or "score"])

    fields = picked.schema if keep else picked.select(id_col).schema
    scored = picked.mapInArrow(run, T.StructType([*fields, T.StructField(keep or "score", T.DoubleType())]))
    if keep:
        return scored
    return scored.select(id_col, F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
