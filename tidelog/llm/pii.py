"""Personal data: patterns that are always found, and a trained tagger that finds more.

The patterns give email addresses, IP addresses, card and phone numbers. Their matches on a bounded sample of
documents, and variants written otherwise (blanks, other separators, capitals), are the labelled spans a
character-level bidirectional LSTM with CRF transitions is trained on. It reads every run of text without blanks that
has a digit or ``@``, and its surroundings, in overlapping windows; where windows overlap, the one in whose middle a
character lies decides, over the whole text. Text without ASCII digits and ``@`` isn't read, so an address spelt
``name (at) host`` isn't found. What the tagger finds is added to the patterns' spans if it has its kind's digits or
parts and reaches beyond them; so are addresses with letters other than ASCII's, whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks
from .tagger import OUTSIDE, Tagger, codes

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, of the step to the next, and kept around a run of text with a digit or @.
SPAN, STEP, AROUND = 64, 32, 16
#: Documents sampled for training (those of least hashed id), windows made up beside theirs, and passes over both.
TRAIN_DOCS, TRAIN_WINDOWS, MADE, EPOCHS = 3000, 600, 700, 10
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_mark = re.compile(r"[0-9@]")
_blank = re.compile(r"\s")
#: Letters of addresses beside ASCII's: Latin, Greek and Cyrillic ones and accents; scripts without blanks aren't parted.
_letters = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0300-\u03ff\u0400-\u04ff\u1e00-\u1fff"
_local = re.compile(f"[{_letters}._%+-]")
_host = re.compile(f"[{_letters}-]+(?:\\.[{_letters}-]+)+")
#: Labels: 0 for none, 1 + 2 k for the beginning of a span of kind k, 2 + 2 k for the rest of it.
LABELS = 1 + 2 * len(KINDS)
ALLOWED = np.ones((LABELS, LABELS), bool)
for _k in range(2, LABELS, 2):
    ALLOWED[:, _k] = False
    ALLOWED[[_k - 1, _k], _k] = True

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _valid(kind: int, found: str) -> bool:
    if kind == 1:
        return all(map(_small, found.split(".")))
    digits = "".join(_digit.findall(found))
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def patterns(text: str) -> list[Span]:
    """The patterns' spans, in order of start and kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    if _digit.search(text):
        for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return sorted(out)


def addresses(text: str) -> list[Span]:
    """Addresses with letters other than ASCII's too, around every @."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:
        a = at
        while a and _local.match(text, a - 1):
            a -= 1
        if a < at and (host := _host.match(text, at + 1)):
            out.append((a, 0, host.end()))
        at = text.find("@", at + 1)
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows that cover all runs without blanks that have a digit or @, and their surroundings."""
    starts, end, stop = [], -1, 0
    for m in _mark.finditer(text):
        if m.start() < stop:
            continue
        start = m.start()
        while start > stop and not text[start - 1].isspace():
            start -= 1
        blank = _blank.search(text, m.end())
        stop = blank.start() if blank else len(text)
        while stop + AROUND > end:  # the next window of a stretch, or the first of a new one
            at = end - SPAN + STEP if starts and end >= start - AROUND else max(0, start - AROUND)
            starts.append(at)
            end = at + SPAN
    return starts


def _coded(text: str, starts: list[int]) -> np.ndarray:
    """Windows of codes; only what they cover is coded."""
    out = np.full((len(starts), SPAN), OUTSIDE, np.int64)
    for row, s in zip(out, starts):
        part = text[max(0, s) : s + SPAN]
        row[max(0, -s) : max(0, -s) + len(part)] = codes(part)
    return out


def _labelled(starts: list[int], spans: list[Span]) -> np.ndarray:
    out = np.zeros((len(starts), SPAN), np.int64)
    for row, s in zip(out, starts):
        for a, kind, b in spans:
            if a < s + SPAN and b > s:
                row[max(0, a - s) : b - s] = 2 + 2 * kind
                if a >= s:
                    row[a - s] = 1 + 2 * kind
    return out


def _made_up(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows with spans of each kind as people also write them, and with numbers that are none."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéñü"
    word = lambda a=2, b=9: "".join(rng.choices(letters, k=rng.randint(a, b)))
    number = lambda k: "".join(rng.choices("0123456789", k=k))

    def card() -> str:
        head = "4" + number(14)
        digits = next(head + c for c in "0123456789" if luhn(head + c))
        sep = rng.choice(["", " ", "-", ".", " "])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        sep, area, rest = rng.choice(" -."), number(3), (number(3), number(4))
        return rng.choice([f"+{number(1)} ({area}) {rest[0]}-{rest[1]}", f"({area}) {rest[0]}{sep}{rest[1]}", f"+{number(2)}{sep}{area}{sep}{rest[0]}{sep}{rest[1]}", f"00{number(2)} {area} {rest[0]} {rest[1]}"])

    makers = (lambda: f"{word()}{rng.choice(['.', '_', '', '+'])}{number(rng.randint(0, 2))}@{word(3, 8)}.{rng.choice(['com', 'org', 'net', 'example.com'])}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, phone)
    others = (lambda: number(rng.randint(1, 8)), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([18, 32, 40]))), lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), lambda: f"password={number(6)}{word()}{number(5)}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"@{word()}", lambda: f"{number(2)}:{number(2)}")
    xs, ys = [], []
    for _ in range(n):
        text, spans = "", []
        while len(text) < SPAN + 8:
            text += " ".join(word() for _ in range(rng.randint(1, 3))) + " "
            if rng.random() < 0.6:
                kind = rng.randrange(4)
                item = makers[kind]()
                if rng.random() < 0.1 and kind == 0:
                    item = item.upper()
                spans.append((len(text), kind, len(text) + len(item)))
                text += item
            else:
                text += rng.choice(others)()
            text += rng.choice([" ", " ", ", ", ".\n"])
        start = [rng.randint(-8, 8)]
        xs.append(_coded(text, start))
        ys.append(_labelled(start, spans))
    return np.concatenate(xs), np.concatenate(ys)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_docs: int = TRAIN_DOCS) -> Tagger:
    """A tagger fitted on the patterns' spans in ``n_docs`` documents at most, and on made-up windows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sample = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(n_docs)  # bounded, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, bytes, bytes]] = []
            for text in batch.column("t").to_pylist():
                if text and (starts := windows(text)):
                    x, y = _coded(text, starts), _labelled(starts, patterns(text))
                    found += [(hash_of(a), a, b) for a, b in ((i.astype(np.uint8).tobytes(), j.astype(np.uint8).tobytes()) for i, j in zip(x, y))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), (pa.int64(), pa.binary(), pa.binary()))], names=["k", "x", "y"])

    cut = rows.join(F.broadcast(sample), "id", "left_semi").mapInArrow(run, "k long, x binary, y binary").distinct().orderBy("k", "x", "y").limit(TRAIN_WINDOWS).collect()
    x, y = _made_up(MADE)
    if cut:
        x = np.concatenate([x, *(np.frombuffer(r.x, np.uint8)[None] for r in cut)])
        y = np.concatenate([y, *(np.frombuffer(r.y, np.uint8)[None].astype(np.int64) for r in cut)])
    tagger = Tagger(LABELS, ALLOWED)
    tagger.fit(x, y, EPOCHS)
    return tagger


def hash_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=7).digest(), "big")


def _plausible(kind: int, found: str) -> bool:
    if kind == 0:
        name, at, host = found.partition("@")
        return bool(name and at) and "." in host.strip(".") and not any(c.isspace() for c in found)
    if kind == 1:
        return len(found.split(".")) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in found.split("."))
    digits = "".join(_digit.findall(found))
    if any(c.isalpha() for c in found):
        return False
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15 and len(found) > len(digits) + 1


def _reconciled(starts: list[int], tags: np.ndarray) -> list[Span]:
    """Spans of one text from its windows' labels: of two windows, each character goes by the one it is further inside."""
    out: list[Span] = []
    k, kind = 0, -1
    while k < len(starts):
        j = k
        while j + 1 < len(starts) and starts[j + 1] < starts[j] + SPAN:
            j += 1
        for w in range(k, j + 1):  # a stretch of overlapping windows, each with its share
            low = 0 if w == k else (starts[w - 1] + SPAN + starts[w]) // 2 - starts[w]
            high = SPAN if w == j else (starts[w] + SPAN + starts[w + 1]) // 2 - starts[w]
            for t in range(low, high):
                tag, at = int(tags[w, t]), starts[w] + t
                if tag and tag % 2 == 0 and kind == tag // 2 - 1 and out and out[-1][2] == at:
                    out[-1] = (out[-1][0], kind, at + 1)
                elif tag:
                    kind = (tag - 1) // 2
                    out.append((at, kind, at + 1))
                else:
                    kind = -1
        kind, k = -1, j + 1
    return out


def _inside(span: Span, spans: list[Span]) -> bool:
    return any(a <= span[0] and span[2] <= b for a, _, b in spans)


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(patterns' spans, all spans) of each text."""
    base = [patterns(t) for t in texts]
    every = [sorted({*b, *(a for a in addresses(t) if not _inside(a, b))}) for t, b in zip(texts, base)]
    starts = [windows(t) for t in texts]
    queue: list[tuple[int, list[int]]] = [(i, s) for i, s in enumerate(starts) if s]
    while queue:
        group, n = [], 0
        while queue and (not group or n + len(queue[0][1]) <= 1024):
            group.append(queue.pop(0))
            n += len(group[-1][1])
        coded = np.concatenate([_coded(texts[i], s) for i, s in group])
        tags = np.concatenate([tagger.decode(coded[k : k + 1024]) for k in range(0, len(coded), 1024)])
        at = 0
        for i, s in group:
            for a, kind, b in _reconciled(s, tags[at : at + len(s)]):
                a, b = max(0, a), min(b, len(texts[i]))
                while a < b and texts[i][a] in " \n\t,;:":
                    a += 1
                while b > a and texts[i][b - 1] in " \n\t,;:.":
                    b -= 1
                if a < b and _plausible(kind, texts[i][a:b]) and not _inside((a, kind, b), every[i]):
                    every[i].append((a, kind, b))
            at += len(s)
            every[i].sort()
    return list(zip(base, every))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the patterns' spans; ``spans`` has the tagger's too (kind:start:end in code points, by
    start, then kind). Null and empty texts have none. Repeated rows give repeated results; a null id stays null; an
    empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "t", 1 << 22):
            rows = []
            for base, every in find([t or "" for t in batch.column("t").to_pylist()], tagger):
                counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """The input's columns with every span of the text replaced by its kind in angle brackets, overlapping ones
    together by that of the first; a null text stays null."""

    def clean(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for a, kind, b in spans:
            if a >= at:
                out += [text[at:a], f"<{KINDS[kind].upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col, 1 << 22):
            texts = batch.column(text_col).to_pylist()
            found = find([t or "" for t in texts], tagger)
            new = [None if t is None else clean(t, every) for t, (_, every) in zip(texts, found)]
            where = batch.schema.get_field_index(text_col)
            yield batch.set_column(where, text_col, pa.array(new, batch.schema.field(where).type))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
