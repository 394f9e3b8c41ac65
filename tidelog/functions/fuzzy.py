"""Fuzzy token matching: edit distance with swaps, over windows as long as the pattern."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TOKEN, tokens

_token = re.compile(f"{TOKEN}+")
_inside = re.compile(r"[a-z0-9_]")
#: Tokens a Python worker remembers.
REMEMBERED = 200_000


def as_bytes(term: str) -> str:
    """Patterns are compared by bytes: one character for each."""
    return term.encode("utf-8").decode("latin-1")


def osa(a: str, b: str, most: int = 1 << 30) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two texts; ``most + 1`` if more."""
    two, one, row = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(one[j] + (x != y), one[j + 1] + 1, row[j] + 1)
            if i and j and x == b[j - 1] and y == a[i - 1]:
                best = min(best, two[j - 1] + 1)
            row.append(best)
        if min(row) > most and min(one) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _far(window: str, pattern: str, k: int) -> bool:
    """Whether more than k of the pattern's characters are missing from the window: each edit makes up for one."""
    for c in pattern:
        left = window.replace(c, "", 1)
        if len(left) == len(window):
            k -= 1
            if k < 0:
                return True
        window = left
    return False


def score(text: str, pattern: str, k: int) -> int:
    """Least distance of the pattern to a window of its length; one more than allowed if none is near enough."""
    m = len(pattern)
    if not m:
        return 0
    k = min(k, m)
    windows = [w for w in {text[i : i + m] for i in range(len(text) - m + 1)} if not _far(w, pattern, k)]
    return min((osa(w, pattern, k) for w in windows), default=k + 1)


def matches(text: str, pattern: str, k: int) -> bool:
    return score(text, pattern, k) <= k


def near_pattern(pattern: str) -> str | None:
    """For distance 1: windows differ in one place or by one swap, which a regular expression can say."""
    ok = [bool(_inside.fullmatch(c)) for c in pattern]
    ways = []
    for i in range(len(pattern)):
        if all(ok[:i] + ok[i + 1 :]):
            ways.append(pattern[:i] + TOKEN + pattern[i + 1 :])
    if all(ok):
        ways += [pattern[:i] + pattern[i + 1] + pattern[i] + pattern[i + 2 :] for i in range(len(pattern) - 1) if pattern[i] != pattern[i + 1]]
    return f"(?i)(?:{'|'.join(ways)})" if ways else None


def _cut(pattern: str, k: int) -> set[str]:
    """Pieces of which k edits leave one whole: they spoil at most 2 k of 2 k + 1. Only those that tokens can have."""
    n = 2 * k + 1
    cut = [len(pattern) * i // n for i in range(n + 1)]
    pieces = {pattern[a:b] for a, b in zip(cut, cut[1:])} if len(pattern) >= n else set()
    return {p for p in pieces if all(_inside.fullmatch(c) for c in p)}


def _pieces(pattern: str, k: int) -> str | None:
    """A pattern all matches meet; None if the term is too short for one."""
    if len(pattern) < 2 * k + 1:
        return None
    pieces = _cut(pattern, k)
    return f"(?i)(?:{'|'.join(sorted(pieces))})" if pieces else "(?!)"


def in_python(term: str, k: int) -> bool:
    """Whether the term is compared in Python."""
    return 1 < k <= len(as_bytes(term))


def may_be_near(token: Column, term: str, k: int) -> Column:
    """A test in the JVM that all (lower) tokens near the term pass: they are as long as it, and all but k of its
    characters are in them, as often as in it, since each edit makes up for one."""
    pattern = as_bytes(term)
    wide = F.octet_length(token)
    there = [F.least(wide - F.octet_length(F.replace(token, F.lit(c))), F.lit(n)) if n > 1 else token.contains(c).cast("int") for c, n in sorted(Counter(filter(_inside.fullmatch, pattern)).items())]
    return (wide >= len(pattern)) & (reduce(Column.__add__, there, F.lit(0)) >= len(pattern) - k)


def _near_udf(pattern: str, k: int):
    @F.pandas_udf("boolean")
    def near(texts: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def one(tokens: str | None) -> bool:
            for token in _token.findall(tokens or ""):
                if token not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[token] = matches(token, pattern, k)
                if known[token]:
                    return True
            return False

        return texts.map(one).astype(bool)

    return near


def predicate(text: Column, term: str, k: int) -> Column:
    """Whether a text has a token near the term. Distance 1 stays in the JVM; beyond it Arrow batches go to Python, with
    nothing of a text but those of its tokens, once each, that may be near."""
    pattern = as_bytes(term)
    if k > len(pattern) or not pattern:
        return text.rlike(TOKEN)  # any token is near enough
    if k == 1:
        near, pieces = near_pattern(pattern), _cut(pattern, 1)
        if not near:
            return F.lit(False)
        low = F.lower(text)  # searching for pieces is cheaper than the pattern, and one of them stays whole
        return reduce(Column.__or__, (low.contains(p) for p in sorted(pieces))) & text.rlike(near) if pieces else text.rlike(near)
    few = F.filter(F.array_distinct(tokens(text)), lambda t: may_be_near(t, term, k))
    near, pieces = _near_udf(pattern, k)(F.array_join(few, " ")), _pieces(pattern, k)
    return text.rlike(pieces) & near if pieces else near


def token_predicate(token: Column, term: str, k: int) -> Column:
    """``predicate`` for lower tokens; what Python compares, beyond distance 1, is nothing that fails ``may_be_near``."""
    pattern = as_bytes(term)
    if k == 1 and pattern and near_pattern(pattern):
        # most tokens are shorter than the term or have none of its pieces, which needs neither pattern nor lowering
        long, pieces = F.octet_length(token) >= len(pattern), _cut(pattern, 1)
        held = long & reduce(Column.__or__, (token.contains(p) for p in sorted(pieces))) if pieces else long
        return held & token.rlike(near_pattern(pattern))
    if not in_python(term, k):
        return predicate(token, term, k)
    return _near_udf(as_bytes(term), k)(F.when(may_be_near(token, term, k), token))


def score_column(text: Column, term: str, k: int) -> Column:
    """``score`` of each text, in Arrow batches."""
    pattern = as_bytes(term)

    @F.pandas_udf("int")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: score(t or "", pattern, k)).astype("int32")

    return scored(text)
