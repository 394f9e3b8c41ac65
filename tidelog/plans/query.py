"""Query language: terms, ``*`` and ``~k``, AND, OR, NOT and parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Distances are held within these.
LEAST_K, MOST_K = 1, 3
_lexeme = re.compile(r"[()]|[^\t\n\f\r ()]+")


class QueryError(ValueError):
    """The query can't be parsed."""


@dataclass(frozen=True)
class Exact:
    term: str


@dataclass(frozen=True)
class Wildcard:
    term: str


@dataclass(frozen=True)
class Fuzzy:
    term: str
    k: int


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Minus:
    """Rows of the left side that the right side hasn't."""

    left: Node
    right: Node


Node = Exact | Wildcard | Fuzzy | And | Or | Minus
NOTHING = Exact("")


def leaf(term: str) -> Node:
    base, near, rest = term.partition("~")
    if "*" in base or not near and "*" in term:
        return Wildcard(base if near else term)
    if not near:
        return Exact(term)
    k = int(rest) if re.fullmatch(r"[+-]?[0-9]{1,4000}", rest) and abs(int(rest)) < 1 << 63 else 1
    return Fuzzy(base, min(max(k, LEAST_K), MOST_K))


def parse(query: str, as_coded: bool = False) -> Node:
    """The tree of a query.

    OR binds least, then AND with NOT as a difference. Negated operands of a chain are taken from what the chain's
    other operands have in common; a chain of negated operands only has no rows. With ``as_coded`` parentheses are
    dropped, NOT stands before an operand only, and its rows are taken from nothing.
    """
    lexemes = [x if x in ("AND", "OR", "NOT") else x.lower() for x in _lexeme.findall(query)]
    if as_coded:
        lexemes = [x for x in lexemes if x not in "()"]
    if not query.strip(" \t\n\f\r\v"):
        raise QueryError("empty query")
    parser = _Parser(lexemes, as_coded)
    tree = parser.either()
    if parser.rest:
        raise QueryError(f"unexpected token: {parser.rest[-1]}")
    return tree


class _Parser:
    def __init__(self, lexemes: list[str], as_coded: bool):
        self.rest = lexemes[::-1]
        self.as_coded = as_coded

    def take(self, *which: str) -> str | None:
        return self.rest.pop() if self.rest and self.rest[-1] in which else None

    def either(self) -> Node:
        tree = self.chain()
        while self.take("OR"):
            tree = Or(tree, self.chain())
        return tree

    def chain(self) -> Node:
        tree, waiting = None, []
        negated, operand = self.operand()
        while True:
            if self.as_coded:
                new = Minus(NOTHING, operand) if negated else operand
                tree = And(tree, new) if tree else new
            elif negated and tree is None:
                waiting.append(operand)
            elif negated:
                tree = Minus(tree, operand)
            elif tree is None:
                tree = operand
                for w in waiting:
                    tree = Minus(tree, w)
            else:
                tree = And(tree, operand)
            if self.take("AND") or not self.as_coded and self.rest and self.rest[-1] == "NOT":
                negated, operand = self.operand()
            else:
                break
        if tree is None:
            tree = NOTHING
            for w in waiting:
                tree = Minus(tree, w)
        return tree

    def operand(self) -> tuple[bool, Node]:
        if self.take("NOT"):
            negated, operand = self.operand()
            if self.as_coded:
                return True, Minus(NOTHING, operand) if negated else operand
            return not negated, operand
        if not self.rest:
            raise QueryError("unexpected end of query")
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise QueryError("missing closing parenthesis" if not self.rest else f"unexpected token: {self.rest[-1]}")
            return False, tree
        if self.rest[-1] == ")":
            raise QueryError("unexpected end of query")
        if self.rest[-1] in ("AND", "OR"):
            raise QueryError(f"unexpected token: {self.rest[-1]}")
        return False, leaf(self.rest.pop())


def leaves(node: Node) -> list[Node]:
    if isinstance(node, (And, Or, Minus)):
        return leaves(node.left) + leaves(node.right)
    return [node]
