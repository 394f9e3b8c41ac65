"""Search: a query tree becomes one predicate over records, and duplicates are told by aggregates.

Records of one key have the same message, and records equal but for case the same tokens, so a leaf is true of all of
a group or of none. Hence only matching records are grouped at all, a boolean query is decided once for each key, and
the first record of a key is a minimum, which is combined before the shuffle.

Records come from segments: fields aren't null, and places are unique. A null or empty message matches nothing. An empty
table gives no results. Of records that differ in nothing but their place, the first in order of (segment, offset)
stands for all, but for a single term, which keeps each. Extra columns are ignored.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..model import FIELDS, KEY, PLACE, with_key
from ..operators.setops import difference, intersect, leaf_dedup, union
from ..sources.staging import remove, staging_dir
from .query import And, Exact, Fuzzy, Minus, Node, Or, Wildcard, leaves, parse


def matches(leaf: Node, message: Column) -> Column:
    if isinstance(leaf, Fuzzy):
        return fuzzy.predicate(message, leaf.term, leaf.k)
    pattern = text.exact_pattern(leaf.term) if isinstance(leaf, Exact) else text.wildcard_pattern(leaf.term)
    if not pattern:
        return F.lit(False)
    part = max(leaf.term.split("*"), key=len)  # a plain search is cheaper than the pattern and passes few messages on
    return F.lower(message).contains(part) & message.rlike(pattern) if part else message.rlike(pattern)


def visible(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("segment_id") >= 0)


def results(rows: DataFrame) -> DataFrame:
    return rows.select(*FIELDS, F.lit(1.0).alias("score"))


def _columns(tree: Node) -> dict[Node, str]:
    return {leaf: f"m{i}" for i, leaf in enumerate(dict.fromkeys(leaves(tree)))}


def _holds(node: Node, names: dict[Node, str]) -> Column:
    """Whether a key's records are in the rows of a node; ``first_of_case`` says if its first is first but for case."""
    if isinstance(node, And):
        return _holds(node.left, names) & _holds(node.right, names)
    if isinstance(node, Or):
        return _holds(node.left, names) | _holds(node.right, names)
    if isinstance(node, Minus):
        return _holds(node.left, names) & ~_holds(node.right, names)
    found = F.col(names[node])
    return found if isinstance(node, Exact) else found & F.col("first_of_case")


def _bag(node: Node) -> bool:
    """Whether a node's rows keep repeated content."""
    return isinstance(node, Exact) or isinstance(node, Minus) and _bag(node.left)


def search(logs: DataFrame, query: str, as_coded: bool = False) -> DataFrame:
    """Matching records with score 1.0; ``logs`` has the record's fields and its place. One filter, no join but for NOT
    after a single term, which keeps repeated content."""
    return results(_rows(logs, parse(query, as_coded)))


def _rows(logs: DataFrame, tree: Node) -> DataFrame:
    names = _columns(tree)
    tests = {name: matches(leaf, F.col("message")) for leaf, name in names.items()}
    seen = visible(logs).select(*FIELDS, *PLACE)
    if isinstance(tree, Exact):
        return seen.filter(tests[names[tree]])
    matched = with_key(seen.withColumns(tests).filter(reduce(Column.__or__, map(F.col, names.values()))))
    keys = matched.groupBy(*KEY, *names.values()).agg(F.min(F.struct(*PLACE, "service", "level")).alias("first"))
    if any(not isinstance(leaf, Exact) for leaf in names):
        # a key's first record comes first of all that differ in case only, if its place is the least of their firsts
        alike = Window.partitionBy("key_service", F.lower("source_file"), "line_no", F.lower("message"), "timestamp")
        keys = keys.withColumn("first_of_case", F.struct("first.segment_id", "first.offset") == F.min(F.struct("first.segment_id", "first.offset")).over(alike))
    if not _bag(tree):
        return keys.filter(_holds(tree, names)).select("first.service", "first.level", "message", "source_file", "line_no", "timestamp", *(F.col(f"first.{p}") for p in PLACE))
    taken, node = [], tree
    while isinstance(node, Minus):
        taken.append(_holds(node.right, names))
        node = node.left
    gone = keys.filter(reduce(Column.__or__, taken)).select(*KEY)
    return matched.filter(F.col(names[node])).join(gone, KEY, "left_anti").select(*FIELDS, *PLACE)


def search_by_sets(logs: DataFrame, query: str, as_coded: bool = False) -> DataFrame:
    """The same by set operations on the rows of each leaf, as the rules are defined; for comparison."""

    def rows(node: Node) -> DataFrame:
        if isinstance(node, (And, Or, Minus)):
            way: Callable = intersect if isinstance(node, And) else union if isinstance(node, Or) else difference
            return way(rows(node.left), rows(node.right))
        found = visible(logs).select(*FIELDS, *PLACE).filter(matches(node, F.col("message")))
        return found if isinstance(node, Exact) else leaf_dedup(found)

    return results(rows(parse(query, as_coded)))


#: So many places at most are brought to the driver to name the records to read; more are joined.
NAMED_PLACES = 1000
#: So many rows of 64 places at most are broadcast to the records; more are joined by a shuffle.
BROADCAST_PLACES = 400_000
#: So many tokens near a term, and bytes of them, at most are broadcast; more are joined by a shuffle.
BROADCAST_TOKENS, BROADCAST_BYTES = 200_000, 8_000_000


def search_postings(logs: DataFrame, postings: DataFrame, query: str, as_coded: bool = False, indexed_to: int | None = None) -> DataFrame:
    """The same from an index: the places of the records that may match, then only those records.

    ``postings`` is read through its token column, so a table sorted by token is pruned; fuzzy terms are compared with
    tokens of the index, not with messages. Few places are named in the records' filter, which skips the segments and
    row groups that have none; many are joined, by a broadcast up to a bound. Segments after ``indexed_to`` aren't in the index yet and are scanned.
    """
    tree = parse(query, as_coded)
    old = logs if indexed_to is None else logs.filter(F.col("segment_id") <= indexed_to)
    wanted = _kept_places(places(postings if indexed_to is None else postings.filter(F.col("segment_id") <= indexed_to), tree))
    rows, many = wanted.agg(F.count("*"), F.coalesce(F.sum(F.bit_count("held")), F.lit(0))).first()
    if many <= NAMED_PLACES:
        named = [(r.segment_id, r.row << 6 | i) for r in wanted.collect() for i in range(64) if r.held >> i & 1]  # bounded
        found = old.filter(_at(named)).select(*FIELDS, *PLACE)
    else:
        found = _records(old, F.broadcast(wanted) if rows <= BROADCAST_PLACES else wanted)
    if indexed_to is not None:
        found = found.unionByName(logs.filter(F.col("segment_id") > indexed_to).select(*FIELDS, *PLACE))
    return results(_rows(found, tree))


def _kept_places(wanted: DataFrame) -> DataFrame:
    """Places as (segment_id, row, held), with a bit for each of the 64 offsets of a row, so that many places of a segment
    take little. They are written: their number decides how records are read, and the index is read once only."""
    spark = wanted.sparkSession
    path = staging_dir(spark)
    atexit.register(remove, spark.sparkContext, path)
    bit = F.expr("shiftleft(1L, cast(`offset` & 63 as int))")
    wanted.groupBy("segment_id", F.shiftright("offset", 6).alias("row")).agg(F.bit_or(bit).alias("held")).write.parquet(path)
    return spark.read.parquet(path)


def _records(logs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records at kept places. The message is given by what the places hold, as tests of messages would else be made
    before the join, on all records."""
    near = logs.select(*FIELDS, *PLACE).withColumn("row", F.shiftright("offset", 6)).join(wanted, ["segment_id", "row"])
    there = F.expr("getbit(held, cast(`offset` & 63 as int)) = 1")
    return near.filter(there).withColumn("message", F.when(there, F.col("message"))).select(*FIELDS, *PLACE)


def _at(named: list) -> Column:
    """Whether a record is at one of some places; which segments and offsets there are at all is said apart, for the scan."""
    by: dict[int, list[int]] = {}
    for segment, offset in named:
        by.setdefault(segment, []).append(offset)
    if not by:
        return F.lit(False)
    each = [(F.col("segment_id") == k) & F.col("offset").isin(v) for k, v in by.items()]
    while len(each) > 1:  # balanced, as deep expressions are slow to plan
        each = [reduce(Column.__or__, each[i : i + 2]) for i in range(0, len(each), 2)]
    return F.col("segment_id").isin(list(by)) & F.col("offset").isin(sorted({o for v in by.values() for o in v})) & each[0]


def _may_hold(node: Node, names: dict[Node, str]) -> Column:
    """Whether a record with these leaves can be in a node's rows; of a difference only the left side is asked, as a
    record on its right may still be left out there for its case."""
    if isinstance(node, Minus):
        return _may_hold(node.left, names)
    if isinstance(node, And):
        return _may_hold(node.left, names) & _may_hold(node.right, names)
    if isinstance(node, Or):
        return _may_hold(node.left, names) | _may_hold(node.right, names)
    return F.col(names[node])


def _asked(node: Node) -> set[Node]:
    """The leaves that ``_may_hold`` asks for."""
    if isinstance(node, Minus):
        return _asked(node.left)
    return _asked(node.left) | _asked(node.right) if isinstance(node, (And, Or)) else {node}


def places(postings: DataFrame, tree: Node) -> DataFrame:
    """Places of all records that may be in a tree's rows. Terms that Python compares meet each token of the index once."""
    names = {leaf: name for leaf, name in _columns(tree).items() if leaf in _asked(tree)}
    slow = {leaf: name for leaf, name in names.items() if isinstance(leaf, Fuzzy) and fuzzy.in_python(leaf.term, leaf.k)}
    tests = {name: token_matches(leaf, F.col("token")) for leaf, name in names.items() if leaf not in slow}
    rows = postings.select("token", *PLACE)
    if slow:
        near = _near_tokens(postings, slow)
        if not tests:
            rows = rows.join(near, "token")
        else:
            rows = rows.join(near, "token", "left").withColumns({name: F.coalesce(name, F.lit(False)) for name in slow.values()})
    marked = rows.filter(reduce(Column.__or__, [*tests.values(), *map(F.col, slow.values())])).withColumns(tests)
    if len(names) == 1:
        return marked.select(*PLACE).distinct()
    held = marked.groupBy(*PLACE).agg(*(F.max(name).alias(name) for name in names.values()))
    return held.filter(_may_hold(tree, names)).select(*PLACE)


def _near_tokens(postings: DataFrame, slow: dict[Fuzzy, str]) -> DataFrame:
    """Tokens of the index near one of the terms at least, and which. What can't be near goes before repetitions are told.
    They are written, so that their size is known: few are broadcast, as a join would else shuffle all postings."""
    spark = postings.sparkSession
    maybe = reduce(Column.__or__, (fuzzy.may_be_near(F.col("token"), leaf.term, leaf.k) for leaf in slow))
    near = postings.select("token").filter(maybe).distinct().withColumns({name: token_matches(leaf, F.col("token")) for leaf, name in slow.items()})
    path = staging_dir(spark)
    atexit.register(remove, spark.sparkContext, path)
    near.filter(reduce(Column.__or__, map(F.col, slow.values()))).write.parquet(path)
    kept = spark.read.parquet(path)
    many, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    return F.broadcast(kept) if many <= BROADCAST_TOKENS and size <= BROADCAST_BYTES else kept


def token_matches(leaf: Node, token: Column) -> Column:
    """A leaf's test of one token; equality and prefixes reach the scan."""
    if isinstance(leaf, Exact):
        return token == leaf.term if leaf.term else F.lit(False)
    if isinstance(leaf, Wildcard):
        start, *rest = leaf.term.split("*")
        if rest == [""]:
            return token.startswith(start) if start else F.lit(True)
        return token.startswith(start) & text.wildcard_match(leaf.term, token)
    return fuzzy.token_predicate(token, leaf.term, leaf.k)
