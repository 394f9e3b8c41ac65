"""Sequence packing by best-fit decreasing.

Each document is tokenized once, in whole. Overlong documents are first cut into full windows; what remains goes, in
order of decreasing length, to the open window it leaves the least room in. A segment tree over remaining capacities
finds that window. Only the pieces' few integers are shuffled, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_for, written

WINDOW = 4096
END_ID = 2
#: Pieces packed together in one task; a block leaves a few windows part-filled, so larger blocks waste less.
BLOCK_PIECES = 60_000
#: Words remembered by a Python worker; beyond it the memory is emptied, which costs time and changes nothing.
REMEMBERED = 1_000_000
#: Below this all agree on letters and their lower case.
LATIN = "\u0100"


class WordIds(dict):
    """Little-endian uint32 ids of a run of text without blanks or line ends, by the tokenizer itself, remembered.

    The tokenizer drops white space and splits at it before anything else, so ids of a text are those of its runs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        mark = word[-1] if word[-1:] in (".", ",") else ""
        stem = word[: len(word) - len(mark)]
        low = stem.lower()
        if low + mark != word or mark:
            if stem.isalpha() and max(stem) < LATIN:  # letters are lower-cased, and parted from a mark, anyhow
                ids = self[low] + (self[mark] if mark else b"")
                if len(word) < 64:
                    self[word] = ids
                return ids
        ids = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode(text: str, known: WordIds) -> bytes:
    return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree whose nodes say if any window lies below."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        if room:
            self.at.setdefault(room, []).append(window)
            node = room + self.leaves
            while node:
                self.any[node] += 1
                node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the (room, window) of least room, ``least`` at the smallest."""
        node = least + self.leaves
        if not self.any[node]:
            while True:
                if node == 1:
                    return None
                if not node & 1 and self.any[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.at[room].pop()
        while node:
            self.any[node] -= 1
            node >>= 1
        return room, window


def best_fit_decreasing(lengths: Iterable[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` must decrease and be at most ``window``."""
    tree, sequence, offset, made = OpenWindows(window), [], [], 0
    for n in lengths:
        room, number = (found := tree.take(n)) or (window, made)
        made += found is None
        sequence.append(number)
        offset.append(window - room)
        tree.add(room - n, number)
    return sequence, offset


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens. Only the last piece of a document isn't full."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "", known) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed once each. A null id is kept as null. An empty
    table gives no rows. Extra columns are ignored. Ties in length go by id, then start, so results don't depend on
    the order of rows. Sequence ids are unique, not consecutive.
    """
    cutting = written(cut(docs, tokenizer, window, end_id, id_col, text_col))
    n_blocks = pieces_for(cutting.count(), BLOCK_PIECES / 1e6)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def ordered(pieces: pa.Table) -> pa.Table:  # no pandas: a null id beside it would round large ids
        by = [("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        pieces = pieces.sort_by(by)
        number, offset = best_fit_decreasing(pieces.column("length").to_pylist(), window)
        sequence = (pieces.column("block").to_numpy().astype(np.int64) << 32) + np.asarray(number, np.int64)
        return pieces.drop_columns("block").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset, pa.int64())).select(names)

    placed = cutting.withColumn("block", F.pmod(F.xxhash64("id", "start"), F.lit(n_blocks)).cast("int"))
    return placed.groupBy("block").applyInArrow(ordered, ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)
