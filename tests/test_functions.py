import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import fuzzy, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize("t,p,found", [("hello world", "world", True), ("hello world", "hello", True), ("hello world", "foo", False), ("hello world", "", True), ("short", "longerpattern", False)])
def test_contains(spark, t, p, found):
    assert one(spark, text.contains(F.col("t"), F.col("p")), t=t, p=p) is found


@pytest.mark.parametrize("t,p,places", [("abababab", "aba", [0, 2, 4]), ("aaa", "", []), ("a", "ab", []), ("éaéa", "a", [2, 5]), ("aaaa", "aa", [0, 1, 2]), ("", "a", [])])
def test_occurrences(spark, t, p, places):
    assert one(spark, text.occurrences(F.col("t"), F.col("p")), t=t, p=p) == places


@pytest.mark.parametrize("a,b,n", [("kitten", "sitting", 3), ("hello", "hello", 0), ("", "abc", 3), ("abc", "", 3), ("flaw", "lawn", 2)])
def test_levenshtein(spark, a, b, n):
    assert one(spark, F.levenshtein("a", "b"), a=a, b=b) == n


@pytest.mark.parametrize("t,p,k,found", [("hello", "hello", 1, True), ("hello", "hallo", 1, True), ("hello", "world", 1, False), ("hello", "helol", 2, True), ("hello", "helol", 0, False), ("sometimes", "time", 1, True), ("tim", "time", 1, False), ("x", "", 1, True), ("zzz", "ab", 3, True)])
def test_fuzzy(t, p, k, found):
    assert fuzzy.matches(t, p, k) is found


def test_fuzzy_scores():
    assert fuzzy.score("hello", "hallo", 1) == 1 and fuzzy.score("hello", "world", 1) > 1


def test_osa():
    assert [fuzzy.osa(*x) for x in (("ab", "ba"), ("abc", "ca"), ("timeout", "tiemout"), ("", "ab"), ("abbc", "bcab"))] == [1, 3, 1, 2, 4]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_predicate_is_the_definition(spark, k):
    rng = random.Random(k)
    words = ["".join(rng.choices("abc_1é-", k=rng.randint(1, 9))) for _ in range(400)]
    tokens = lambda w: __import__("re").findall("[a-zA-Z0-9_]+", w)
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).cache()
    for p in ["ab", "abc", "a", "", "ab-c", "é", "abcab", "cb_a1b", "aabbccab"]:
        got = [r[0] for r in df.select(fuzzy.predicate(F.col("w"), p, k)).collect()]
        q = fuzzy.as_bytes(p)
        want = [any(k > len(q) or fuzzy.matches(t, q, k) for t in tokens(w)) for w in words]
        assert got == want, p
    df.unpersist()


@pytest.mark.parametrize("p,t,found", [("auth*", "authenticate", True), ("auth*", "xyz", False), ("a?b", "axb", False), ("a?b", "a?b", True), ("a*c*", "abcx", True), ("*", "", True), ("a.c", "abc", False)])
def test_wildcard(spark, p, t, found):
    assert one(spark, text.wildcard_match(p, F.col("t")), t=t) is found


@pytest.mark.parametrize("f,t,out", [(text.normalize_token, "Hello", "hello"), (text.normalize_token, " Foo ", "foo"), (text.normalize_token, "WORLD", "world"), (text.is_valid_token, "hello", True), (text.is_valid_token, "foo_bar", True), (text.is_valid_token, "hello world", False), (text.is_valid_token, "", False), (text.clean_term, "Error", "error"), (text.clean_term, "..Ab-c!", "ab-c"), (text.tokens, "Hello, WORLD foo_bar 42", ["hello", "world", "foo_bar", "42"]), (text.tokens, "", []), (text.tokens, "Ünï", ["n"])])
def test_scalars(spark, f, t, out):
    assert one(spark, f(F.col("t")), t=t) == out


def test_case_kept(spark):
    assert one(spark, text.tokens(F.col("t"), lower=False), t="HELLO World") == ["HELLO", "World"]


def test_shards(spark):
    def shard(token, n):
        h = 0
        for c in token:
            h = (h * 31 + ord(c)) % 2**64
        return abs(h - 2**64 if h >= 2**63 else h) % n

    words = ["", "a", "hello", "z" * 50, "timeout", "x_1"]
    got = spark.createDataFrame([(w,) for w in words], "t string").coalesce(1).select(text.token_hash("t", 8)).collect()
    assert [r[0] for r in got] == [shard(w, 8) for w in words]


def test_tokens_of_all_characters(spark):
    """Only ASCII letters are letters of tokens, whatever other characters become in lower case."""
    import re

    t = "".join(f"A{chr(c)}Z\u212a\u0130_{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    parts = [t[i : i + 100_000] for i in range(0, len(t), 100_000)] + ["", "Ab K\u212ab \u0130I"]
    found = spark.createDataFrame([(x,) for x in parts], "t string").select("t", text.tokens("t").alias("low"), text.tokens("t", lower=False).alias("raw")).collect()
    for r in found:
        want = re.findall("[a-zA-Z0-9_]+", r.t)
        assert r.raw == want and r.low == [w.lower() for w in want]


@pytest.mark.parametrize("term,k", [("licnese", 2), ("lisencse", 3), ("abc", 3), ("aab", 2), ("é9", 2), ("x-y", 2)])
def test_python_gets_few_tokens(spark, term, k, monkeypatch):
    """What leaves the JVM is much less than the texts, and no near token is left behind."""
    rng = random.Random(term)
    words = ["".join(rng.choices("lisencabx9_", k=rng.randint(1, 12))) for _ in range(3000)] + ["License", "LISCENES9", "aAb", "abx"]
    texts = ["-".join(rng.choices(words, k=30)) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", fuzzy.predicate(F.col("t"), term, k).alias("near")).collect()
    lower = lambda t: [w.lower() for w in fuzzy._token.findall(t or "")]
    assert [bool(r.near) for r in got] == [any(fuzzy.matches(w, fuzzy.as_bytes(term), k) for w in lower(r.t)) for r in got]
    tokens = spark.createDataFrame([(w.lower(),) for w in words], "w string")
    assert [bool(r.near) for r in tokens.select(fuzzy.token_predicate(F.col("w"), term, k).alias("near")).collect()] == [fuzzy.matches(w.lower(), fuzzy.as_bytes(term), k) for w in words]
    if term == "lisencse":
        sent = []
        monkeypatch.setattr(fuzzy, "_near_udf", lambda *_: lambda column: sent.append(column) or column.contains(""))
        fuzzy.predicate(F.col("t"), term, k)
        bytes_sent, all_bytes = df.select(F.sum(F.octet_length(sent[0])), F.sum(F.octet_length("t"))).first()
        assert bytes_sent < all_bytes / 2
