"""Scalar text functions over columns; all of them run in the JVM. A null text gives null, an empty one no tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-zA-Z0-9_]"
_literal = re.compile(r"[a-z0-9_]*")


def tokens(text: Column | str, lower: bool = True) -> Column:
    """Maximal runs of ASCII letters, digits and underscores, in order, with repetitions."""
    text = F.col(text) if isinstance(text, str) else text
    if not lower:
        return F.regexp_extract_all(text, F.lit(f"{TOKEN}+"), F.lit(0))
    # lowered as a whole, which is cheaper than token by token, without the two other characters that become ASCII letters
    odd = text.contains("\u212a") | text.contains("\u0130")
    low = F.lower(F.when(odd, F.translate(text, "\u212a\u0130", "  ")).otherwise(text))
    return F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))


def normalize_token(token: Column | str) -> Column:
    return F.lower(F.regexp_replace(token, r"^[\s\u0085 ]+|[\s\u0085 ]+$", ""))


def is_valid_token(token: Column | str) -> Column:
    return F.col(token).rlike(r"^[\p{L}\p{Nd}_]+\z") if isinstance(token, str) else token.rlike(r"^[\p{L}\p{Nd}_]+\z")


def clean_term(term: Column | str) -> Column:
    return F.lower(F.regexp_replace(term, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))


def query_terms(query: Column | str) -> Column:
    return F.regexp_extract_all(query, F.lit("[a-zA-Z0-9_*~]+"), F.lit(0))


def contains(text: Column, pattern: Column) -> Column:
    """Whether the pattern occurs; the empty one always does."""
    return F.contains(text, pattern)


def occurrences(text: Column, pattern: Column) -> Column:
    """0-based byte offsets of all occurrences, overlapping ones too; none for the empty pattern."""
    raw, wanted = F.encode(text, "utf-8"), F.encode(pattern, "utf-8")
    last = F.octet_length(raw) - F.octet_length(wanted)
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(raw, i + 1, F.octet_length(wanted)) == wanted)
    return F.when((F.octet_length(wanted) == 0) | (last < 0), F.array().cast("array<int>")).otherwise(places)


def token_hash(token: Column | str, shards: int) -> Column:
    """The shard of a token by a 31-multiplier hash that wraps at 64 bits; exact, in decimals, as integers may not wrap here."""
    wrap = F.expr("18446744073709551616BD")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    folded = F.aggregate(chars, F.lit(0).cast("decimal(38,0)"), lambda h, c: F.pmod(h * 31 + F.ascii(c), wrap).cast("decimal(38,0)"))
    signed = F.when(folded >= F.expr("9223372036854775808BD"), wrap - folded).otherwise(folded)
    return F.pmod(signed, F.lit(shards)).cast("int")


def exact_pattern(term: str) -> str | None:
    """A pattern that texts with the token match; None if no text can have it."""
    return _bounded(term) if term and _literal.fullmatch(term) else None


def wildcard_pattern(term: str) -> str | None:
    """As for tokens, with ``*`` for any run of token characters, the empty one too."""
    parts = term.split("*")
    if not all(_literal.fullmatch(p) for p in parts):
        return None
    if not any(parts):
        return f"{TOKEN}"
    return _bounded(f"{TOKEN}*".join(parts))


def _bounded(inner: str) -> str:
    return f"(?i)(?<!{TOKEN}){inner}(?!{TOKEN})"


def wildcard_match(pattern: str, text: Column) -> Column:
    """The whole text, ``*`` standing for anything but line ends and all else for itself."""
    return text.rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + r"\z")
