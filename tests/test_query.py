import pytest

from tidelog.plans.query import NOTHING, And, Exact, Fuzzy, Minus, Or, QueryError, Wildcard, parse

A, B, C = Exact("a"), Exact("b"), Exact("c")


@pytest.mark.parametrize(
    "query,tree",
    [
        ("error AND timeout", And(Exact("error"), Exact("timeout"))),
        ("auth*", Wildcard("auth*")),
        ("tiemout~1", Fuzzy("tiemout", 1)),
        ("a OR b AND c", Or(A, And(B, C))),
        ("a AND (b OR c)", And(A, Or(B, C))),
        ("a AND b NOT c", Minus(And(A, B), C)),
        ("a AND NOT b", Minus(A, B)),
        ("a OR NOT b", Or(A, Minus(NOTHING, B))),
        ("NOT a AND b", Minus(B, A)),
        ("NOT NOT a", A),
        ("NOT a", Minus(NOTHING, A)),
        ("A and".split()[0], A),
        ("and", Exact("and")),
        ("a~", Fuzzy("a", 1)),
        ("a~0", Fuzzy("a", 1)),
        ("a~9", Fuzzy("a", 3)),
        ("a~-1", Fuzzy("a", 1)),
        ("a~b~2", Fuzzy("a", 1)),
        ("a~99999999999999999999", Fuzzy("a", 1)),
        ("time*ut~1", Wildcard("time*ut")),
        ("~2", Fuzzy("", 2)),
        ("err-504", Exact("err-504")),
        ("a b", Exact("a b")),
        ("  Foo  ", Exact("foo")),
    ],
)
def test_trees(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize("query,error", [("", "empty query"), ("  ", "empty query"), ("foo bar", "unexpected token: bar"), ("a AND", "unexpected end of query"), ("OR a", "unexpected token: OR"), ("()", "unexpected end of query"), ("(a", "missing closing parenthesis"), ("a)", "unexpected token: )")])
def test_errors(query, error):
    with pytest.raises(QueryError, match=f"^{error.replace(')', '[)]')}$"):
        parse(query)


def test_as_coded():
    assert parse("a AND (b OR c)", as_coded=True) == Or(And(A, B), C)
    assert parse("a AND NOT b", as_coded=True) == And(A, Minus(NOTHING, B))
    assert parse("NOT NOT a", as_coded=True) == Minus(NOTHING, Minus(NOTHING, A))
    assert parse("((a", as_coded=True) == A
    with pytest.raises(QueryError, match="unexpected token: NOT"):
        parse("a AND b NOT c", as_coded=True)
    with pytest.raises(QueryError, match="unexpected end of query"):
        parse("()", as_coded=True)
