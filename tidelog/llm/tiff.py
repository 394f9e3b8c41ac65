"""TIFF columns: images from bytes to pages and back.

The reader walks the image file directories of classic TIFF in either byte order, decodes strips or tiles that are
stored plainly or by PackBits, LZW or deflate, undoes horizontal differencing and gives one row per page. The writer
makes multi-page files of 8-bit grey samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8

PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of each TIFF field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, PAGE_ROWS, STRIP_ROWS = 576, 256, 64


class TiffError(ValueError):
    """The bytes aren't a TIFF this reader knows."""


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    layout: str
    data: np.ndarray  # height x width x samples


def unpack_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends; widths change one code early."""
    out: list[bytes] = []
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, last, width, bits, held = first.copy(), b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = first.copy(), b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of the table")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = entry
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    size, have = 258, b""
    put(256)
    for i in range(len(data)):
        longer = have + data[i : i + 1]
        if longer in table:
            have = longer
            continue
        put(table[have])
        table[longer] = size
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
        have = data[i : i + 1]
        if size == 4094:
            put(table[have])
            have = b""
            put(256)
            table, size, width = {bytes((k,)): k for k in range(256)}, 258, 9
    if have:
        put(table[have])
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


UNPACK = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_packbits}
PACK = {PLAIN: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_packbits}


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, fields by tag) of each directory; a loop among directories ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            fields = {}
            for k in range(n):
                where = at + 2 + 12 * k
                tag, kind, count = struct.unpack_from(order + "HHI", data, where)
                if kind not in KINDS:
                    continue
                size = SIZES[kind] * count
                start = where + 8 if size <= 4 else struct.unpack_from(order + "I", data, where + 8)[0]
                fields[tag] = struct.unpack_from(f"{order}{count}{KINDS[kind]}", data, start)
            (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        except struct.error as e:
            raise TiffError("a directory lies outside of the file") from e
        yield order, fields
        at = following


def pages(data: bytes) -> Iterator[Page]:
    """Decoded pages of a file of 8-bit or 16-bit samples, chunky or planar."""
    for order, f in directories(data):
        one = lambda tag, default: (f.get(tag) or (default,))[0]  # noqa: B023, E731
        width, height, samples, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
        compression, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
        if bits not in (8, 16) or compression not in UNPACK or predictor not in (1, 2) or planar not in (1, 2) or width < 1 or height < 1 or samples < 1:
            raise TiffError(f"not supported: {bits} bits, compression {compression}, predictor {predictor}")
        tiled = 324 in f
        across, down = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
        if across < 1 or down < 1:
            raise TiffError("strips or tiles without a size")
        offsets, counts = (f.get(324, ()), f.get(325, ())) if tiled else (f.get(273, ()), f.get(279, ()))
        planes = samples if planar == 2 else 1
        deep = samples // planes
        dtype = np.dtype(f"{order}u{bits // 8}")
        per_row, per_column = -(-width // across), -(-height // down)
        if not len(offsets) == len(counts) == per_row * per_column * planes:
            raise TiffError(f"{len(offsets)} strips or tiles where the size needs {per_row * per_column * planes}")
        out = np.zeros((height, width, samples), dtype)
        for k, (offset, count) in enumerate(zip(offsets, counts)):
            plane, place = divmod(k, per_row * per_column)
            y, x = place // per_row * down, place % per_row * across
            rows = down if tiled else min(down, height - y)
            raw = np.frombuffer(UNPACK[compression](data[offset : offset + count]), dtype)
            if raw.size < rows * across * deep:
                raise TiffError("a strip or tile is too short")
            block = raw[: rows * across * deep].reshape(rows, across, deep)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
            part = out[y : y + rows, x : x + across, plane * deep : plane * deep + deep]
            part[...] = block[: part.shape[0], : part.shape[1]]
        yield Page(width, height, samples, bits, compression, predictor, "tiles" if tiled else "strips", out)


def make(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file with a page for each 8-bit image (height x width), in strips or in tiles of so many rows and columns."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width = image.shape
        parts = []
        step_y, step_x = tile or (strip_rows, width)
        for y in range(0, height, step_y):
            for x in range(0, width, step_x):
                block = image[y : y + step_y, x : x + step_x]
                if tile and block.shape != tile:
                    block = np.pad(block, ((0, tile[0] - block.shape[0]), (0, tile[1] - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                parts.append(PACK[compression](block.tobytes()))
        offsets = []
        for p in parts:
            offsets.append(len(out))
            out += p + b"\0" * (len(p) & 1)
        counts = [len(p) for p in parts]
        fields = {256: (width,), 257: (height,), 258: (8,), 259: (compression,), 262: (1,), 277: (1,), 317: (predictor,)}
        fields |= {322: (tile[1],), 323: (tile[0],), 324: offsets, 325: counts} if tile else {273: offsets, 278: (strip_rows,), 279: counts}
        arrays = {}
        for tag, values in fields.items():
            if len(values) > 1:
                arrays[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag in sorted(fields):
            out += struct.pack(order + "HHII", tag, 4, len(fields[tag]), arrays.get(tag, fields[tag][0]))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def read_pages(files: DataFrame, id_col: str, file_col: str) -> DataFrame:
    """One row per page: id, page, width, height, samples, bits, compression, predictor, layout, data, error.

    A null or empty file has no rows. A file that can't be read gives its pages up to the fault, then a row with
    ``error`` set and other columns null. Repeated rows give repeated pages; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                data = data.as_py()
                if not data:
                    continue
                rows, k = [], 0
                try:
                    for k, p in enumerate(pages(data), 1):
                        rows.append((key.as_py(), k - 1, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.layout, p.data.tobytes(), None))
                except (ArithmeticError, LookupError, MemoryError, ValueError, struct.error, zlib.error) as e:  # a bad file is its own row's fault
                    rows.append((key.as_py(), k, *[None] * 8, str(e) or type(e).__name__))
                types = [batch.schema.types[0], *[pa.int32()] * 7, pa.string(), pa.binary(), pa.string()]
                names = ["id", "page", "width", "height", "samples", "bits", "compression", "predictor", "layout", "data", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    kind = files.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, page int, width int, height int, samples int, bits int, compression int, predictor int, layout string, data binary, error string"
    return files.select(F.col(id_col).alias("id"), F.col(file_col).alias("f")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: How texts are stored: compression, predictor, rows and columns of a tile (none: strips) and byte order, by a text's checksum. LZW
#: and PackBits are coded byte by byte here, so they are one of six.
WAYS = [(c, p, t, o) for c in (DEFLATE,) * 10 + (LZW, PACKBITS) for p in (1, 2) for t in (None, (16, 288)) for o in "<>"]


def store(text: bytes) -> tuple[bytes, int]:
    """A text as a TIFF, and its payload's length: rows of 576 samples, filled up with 255, in pages of 256 rows.

    Its checksum chooses one of ``WAYS``, so that a table of texts goes through all of the reader.
    """
    rows = max(1, -(-len(text) // WIDTH))
    image = np.full(rows * WIDTH, 255, np.uint8)
    image[: len(text)] = np.frombuffer(text, np.uint8)
    image = image.reshape(rows, WIDTH)
    compression, predictor, tile, order = WAYS[zlib.crc32(text) % len(WAYS)]
    return make([image[y : y + PAGE_ROWS] for y in range(0, rows, PAGE_ROWS)], compression, predictor, tile=tile, order=order), rows * WIDTH


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Texts stored as TIFF, read back and measured, one row per input row; with ``keep_media`` also the file.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (pages, mean
    and spread of the samples, and how many values occur). Null texts are empty, and fill one row of 255. Equal texts
    give equal values, repeated rows included; an empty table gives no rows; extra columns are ignored.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    kept = 7 + keep_media

    def measured(text: bytes) -> tuple:
        media, _ = store(text)
        read = list(pages(media))
        payload = b"".join([p.data.tobytes() for p in read])
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        mean = int(counts @ np.arange(256)) / len(payload)
        spread = (int(counts @ (np.arange(256) ** 2)) / len(payload) - mean**2) ** 0.5
        feature = f"pages={len(read)};mean={mean:.4f};std={spread:.4f};values={np.count_nonzero(counts)}"
        return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media)[:kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "t", 1 << 22):
            rows = [measured(t) for t in utf8(batch.column("t"))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *names[:kept]])

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return picked.mapInArrow(run, schema + ", media binary" * keep_media).withColumnRenamed("id", id_col)
