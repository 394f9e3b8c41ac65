"""Set operations on search results by a record's key; the first record in order of place stands for its key.

First rows are found by a minimum that is combined before the shuffle and joined by place, which is unique, so neither
side is skewed by content that repeats.

Rows are stored records, whose fields are never null (validation sees to that); their places are unique. Empty tables
give what the operations say: nothing, or the other side. Extra columns of the first table stay, in ``union`` those of
the second must be the same; a column ``key_service`` must not be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, PLACE, with_key


def _firsts(rows: DataFrame, by: list[Column | str]) -> DataFrame:
    first = rows.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("first")).select("first.*")
    return rows.join(first, PLACE, "left_semi").dropDuplicates(PLACE)


def first_of_key(rows: DataFrame) -> DataFrame:
    return _firsts(with_key(rows), KEY).drop("key_service")


def leaf_dedup(rows: DataFrame) -> DataFrame:
    """One row of those whose text fields differ in case only."""
    return _firsts(rows, [F.lower("service"), F.lower("source_file"), "line_no", F.lower("message"), "timestamp"])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose key is in b, one for each key."""
    return with_key(first_of_key(a)).join(with_key(b).select(*KEY).distinct(), KEY, "left_semi").select(a.columns)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, one for each key: a's if it has one."""
    more = with_key(first_of_key(b)).join(with_key(a).select(*KEY).distinct(), KEY, "left_anti").select(a.columns)
    return first_of_key(a).unionByName(more)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose key isn't in b, repeated ones too."""
    return with_key(a).join(with_key(b).select(*KEY).distinct(), KEY, "left_anti").select(a.columns)
