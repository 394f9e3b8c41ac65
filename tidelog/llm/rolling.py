"""Vectorised hashing of words, shingles and byte windows, sliding minima and runs."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Bytes hashed at a time; temporary arrays hold a few 8-byte values for each.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64
_blank = re.compile(rb"[\x20\x09-\x0d]")
_is_blank = np.zeros(256, bool)
_is_blank[[32, 9, 10, 11, 12, 13]] = True


def _series(factor: int, n: int) -> np.ndarray:
    powers = np.full(n, factor, U64)
    powers[0] = 1
    return np.cumprod(powers, dtype=U64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = _series(int(BASE), n)
            self.down = _series(pow(int(BASE), -1, 1 << 64), n)
        return self.up, self.down


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers of the base; ``between`` turns two of them into a hash of what lies between."""
    up, _ = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], dtype=U64, out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` values, mixed."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, U64)
    _, down = _powers(len(sums))
    return mix((sums[size:] - sums[:-size]) * down[:n])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of ``data``; words are runs of bytes other than ASCII white space.

    Works through the bytes in chunks that end between words. A word longer than a chunk is hashed on its own.
    """
    whole = np.frombuffer(data, np.uint8)
    starts, ends, hashes, at = [], [], [], 0
    while at < len(whole):
        stop = min(len(whole), at + CHUNK)
        if stop < len(whole):
            last = np.flatnonzero(_is_blank[whole[at:stop]])
            if len(last):
                stop = at + int(last[-1]) + 1
            else:
                found = _blank.search(data, stop)
                stop = found.start() if found else len(whole)
                if stop - at > CHUNK:
                    starts.append(np.array([at]))
                    ends.append(np.array([stop]))
                    hashes.append(np.array([xxhash.xxh3_64_intdigest(data[at:stop])], U64))
                    at = stop
                    continue
        part = whole[at:stop]
        edge = np.diff(_is_blank[part].view(np.int8), prepend=np.int8(1), append=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = prefix_sums(part.astype(U64) + U64(1))
        hashes.append(mix(between(sums, start, end) + (end - start).astype(U64)))
        starts.append(start + at)
        ends.append(end + at)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def second(values: np.ndarray) -> np.ndarray:
    """Values replaced one by one, so that hashes of them are independent of the first hashes."""
    return mix(values ^ U64(0xA0761D6478BD642F))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each window of ``size`` values, by doubling."""
    if len(values) < size:
        return values[:0]
    have, width = values, 1
    while 2 * width <= size:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = size - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have
