"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. The tokens of a prefix of a piece of text are themselves the encoding of that prefix, and a row of tokens
is an encoding just when each adjacent pair is one. So a token that ends at a byte can only follow one particular
token that ended where it begins. A state of the transducer is what is still open at a byte: for each of the last few
bytes, the token of the encoding that ends there. Reading a byte finds the token ending at it; tokens that all open
ends share are settled and emitted. States and their transitions are made when first met. No token is longer than
``longest`` bytes, which bounds the lookahead.

Decoding. Tokens' bytes pass through the UTF-8 state machine, which holds back at most three bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: States and pieces remembered by a Python worker; beyond it the memory is emptied, which changes no result.
STATES, PIECES = 300_000, 500_000
BYTES = [bytes((i,)) for i in range(256)]
NONE = 1 << 60
#: Below this, Python and the pattern agree on letters in any Unicode version.
LATIN = "\u0250"
#: The pattern for which single blanks are boundaries (the public tokenizers' pattern).
BY_BLANK = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Transducer:
    """BPE of ``ranks`` over bytes. ``ranks``: token bytes to rank, lower merging first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {t[:i] for t in ranks for i in range(len(t))}  # proper ones, the empty one included
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: the bytes not settled; for each, the length of the token that ends there (0: none that matters);
        #: the token before them, if a token may still begin with them.
        self.of: list[tuple[bytes, bytes, bytes]] = [(b"", b"", b"")]
        self.states = {self.of[0]: 0}
        #: By 256 * state + byte: the next state, or a pair of it and the ranks emitted.
        self.next: dict[int, int | tuple[int, list[int]]] = {}

    def merge(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """The definition: of adjacent parts, the pair of least rank is merged first, leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [self.ranks.get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while len(parts) > down_to:
            least = min(ranks, default=NONE)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.ranks.get(parts[at - 1] + parts[at], NONE)
            if at < len(ranks):
                ranks[at] = self.ranks.get(parts[at] + parts[at + 1], NONE)
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes a token last; None for a token that merging never makes."""
        if token not in self.split:
            parts = self.merge(token, 2)
            self.split[token] = (parts[0], parts[-1]) if len(parts) <= 2 else None
        return self.split[token]

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether token b may come after token a (empty: the beginning).

        It may if no merge across their border comes before the merges that make the tokens at the border, which are
        undone one by one, the latest first.
        """
        if self.halves(b) is None:
            return False
        if not a:
            return True
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.separate(a, b)
        return found

    def separate(self, a: bytes, b: bytes) -> bool:
        ranks, limit = self.ranks, NONE
        while True:
            if ranks.get(a + b, NONE) < limit:
                return False
            left, right = ranks[a], ranks[b]
            if left > right and len(a) > 1 or len(b) == 1:
                if len(a) == 1:
                    return True
                limit, a = left, self.halves(a)[1]
            else:
                limit, b = right + 1, self.halves(b)[0]

    def step(self, state: int, byte: int) -> int | tuple[int, list[int]]:
        tail, ends, before = self.of[state]
        tail += BYTES[byte]
        n = len(tail)
        for at in range(max(0, n - self.longest), n):  # the one token that fits
            if at and not ends[at - 1]:
                continue
            token = tail[at:]
            if token in self.ranks and self.follows(tail[at - ends[at - 1] : at] if at else before, token):
                ends += BYTES[n - at]
                break
        else:
            raise ValueError(f"no token ends at {tail!r}")
        # settle tokens that all open ends share: an end is open while the bytes after it begin some token
        emitted = []
        while True:
            start_open = tail in self.prefixes
            if start_open and n == 1:
                break
            useful, first = self.open_ends(tail, ends)
            if len(useful) < n - ends.count(0):
                ends = bytes([e if i in useful else 0 for i, e in enumerate(ends, 1)])
            if start_open or not first:
                break
            emitted.append(self.ranks[tail[:first]])
            before, tail, n = tail[:first], tail[first:], n - first
            ends = ends[first:]
            if not n:
                start_open = True
                break
            if any(e > i for i, e in enumerate(ends, 1)):
                ends = bytes([e if e <= i else 0 for i, e in enumerate(ends, 1)])
        key = tail, ends, before if start_open else b""
        if (number := self.states.get(key)) is None:
            number = self.states[key] = len(self.of)
            self.of.append(key)
        found = self.next[state << 8 | byte] = (number, emitted) if emitted else number
        return found

    def open_ends(self, tail: bytes, ends: bytes) -> tuple[set[int], int]:
        """All ends that lead to an open end, and the first of them if it is the same on all ways (else 0)."""
        useful: set[int] = set()
        first = -1
        for p in range(len(tail), 0, -1):
            if ends[p - 1] and p not in useful and tail[p:] in self.prefixes:
                while p not in useful:
                    useful.add(p)
                    at = p - ends[p - 1]
                    if not at:
                        first = p if first < 0 else 0
                        break
                    p = at
        return useful, max(first, 0)

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.of) > STATES:
            self.reset()
        state, out, known = 0, [], self.next
        for byte in piece:
            found = known.get(state << 8 | byte)
            if found is None:
                found = self.step(state, byte)
            if found.__class__ is int:
                state = found
            else:
                state, emitted = found
                out += emitted
        tail, ends, _ = self.of[state]
        at, rest = len(tail), []
        while at:
            rest.append(self.ranks[tail[at - ends[at - 1] : at]])
            at -= ends[at - 1]
        return out + rest[::-1]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder(dict):
    """Ids, joined by commas, of the stretches of a text between single blanks; remembered.

    With the usual patterns, where a blank joins what follows it, a match begins at each blank that has no white space
    beside it, whatever else the text holds. A text in which this isn't plain is matched as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.pattern = pattern
        self.pieces = regex.compile(pattern).findall
        self.by_blank = pattern == BY_BLANK
        self.known: dict[str, str] = {}
        self.tokens = {str(i): b for b, i in self.transducer.ranks.items()}

    def piece(self, piece: str) -> str:
        if (ids := self.known.get(piece)) is None:
            ids = ",".join(map(str, self.transducer.encode(piece.encode("utf-8"))))
            if len(piece) < 64:
                if len(self.known) >= PIECES:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def __missing__(self, stretch: str) -> str:
        if not stretch or stretch != stretch.strip():
            raise LookupError("white space beside a blank")
        if stretch[-1] in ".,":
            word, mark = stretch[:-1], stretch[-1]
        else:
            word, mark = stretch, ""
        if word.isalpha() and max(word) < LATIN:  # nothing to match: a blank with letters, perhaps a mark
            ids = self.piece(" " + word) + ("," + self.piece(mark) if mark else "")
        else:
            ids = ",".join(map(self.piece, self.pieces(" " + stretch)))
        if len(stretch) < 64:
            if len(self) >= PIECES:
                self.clear()
            self[stretch] = ids
        return ids

    def encode(self, text: str) -> str:
        """The ids of a text as decimal numbers joined by commas."""
        if self.by_blank:
            first, *rest = text.split(" ")
            try:
                ids = ",".join(map(self.__getitem__, rest))
                if not rest or first and first == first.strip():
                    return ",".join([*map(self.piece, self.pieces(first)), ids] if rest else map(self.piece, self.pieces(first)))
            except LookupError:
                pass
        return ",".join(map(self.piece, self.pieces(text)))


@lru_cache(1)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


class Utf8:
    """Incremental UTF-8 state machine: ``feed`` returns the characters that are whole so far.

    The state is the number of bytes still missing and the bytes held, three at most; wrong bytes raise an error.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def missing(lead: int) -> int:
        return 0 if lead < 0x80 else 1 if lead >> 5 == 6 else 2 if lead >> 4 == 14 else 3 if lead >> 3 == 30 else 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(4, len(data) + 1)):  # the last lead byte says if its character is whole
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                keep = back if self.missing(byte) >= back else 0
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8")

    def close(self) -> None:
        if self.held:
            raise ValueError("the last character isn't whole")


def decode_stream(ids: list[str], tokens: dict[str, bytes], step: int = 4096) -> Iterator[str]:
    """Text of a stream of ids, some ids at a time."""
    machine = Utf8()
    for i in range(0, len(ids), step):
        yield machine.feed(b"".join(map(tokens.__getitem__, ids[i : i + step])))
    machine.close()


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and ids (comma-joined) with ``keep_ids``.

    A null text is empty: no tokens, digests of nothing. Repeated rows give repeated results; a null id stays null;
    an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(ranks, pattern)
        for batch in blocks(batches, "t", 1 << 22):
            counts, digests, decoded, kept = [], [], [], []
            for text in batch.column("t").to_pylist():
                joined = known.encode(text or "")
                listed = joined.split(",") if joined else []
                back = hashlib.sha256()
                for part in decode_stream(listed, known.tokens):
                    back.update(part.encode("utf-8"))
                counts.append(len(listed))
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(back.hexdigest())
                if keep_ids:
                    kept.append(joined)
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * keep_ids, names=names + ["ids"] * keep_ids)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * keep_ids
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
