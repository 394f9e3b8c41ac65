"""Reading JSON records: strict types, required fields, defaults; what isn't accepted is kept with its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIELDS, RECORD


def error_text(field: str) -> Column:
    return F.concat(F.lit("missing required field: "), F.lit(field))


def validated(records: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Records with defaults and an ``error`` column, null where the record is accepted.

    Service, then message must not be empty; level defaults to INFO, timestamp to now when absent or 0, other fields
    to empty and 0.
    """
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    stamp = F.coalesce(F.col("timestamp").cast("long"), F.lit(0))
    error = F.when(text("service") == "", error_text("service")).when(text("message") == "", error_text("message"))
    return records.withColumns(
        {
            "service": text("service"),
            "level": F.when(text("level") == "", "INFO").otherwise(F.col("level")),
            "message": text("message"),
            "source_file": text("source_file"),
            "line_no": F.coalesce(F.col("line_no").cast("long"), F.lit(0)),
            "timestamp": F.when(stamp == 0, now).otherwise(stamp),
            "error": error,
        }
    )


def decoded(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts as records, unchecked, with ``raw`` and ``wrong``, which is true of texts that are no record: keys in any
    case, others ignored, types not converted. A field that isn't there is empty or 0, one that is null is null. Fields
    of up to 128 MB are read, which is Spark's bound for a variant."""
    fields = F.from_json(F.col(column), "map<string,variant>", {"maxStringLen": str((1 << 31) - 1)})
    low = raw.select(F.col(column).alias("raw"), fields.alias("_m"))
    # of keys that differ in case only the last counts
    wanted = {f.name: f.dataType.simpleString() for f in RECORD}
    keys = F.map_keys("_m")
    named = lambda name: F.filter(keys, lambda k: F.lower(k) == name)
    for name in wanted:
        low = low.withColumn(f"_{name}", F.try_element_at("_m", F.try_element_at(named(name), F.lit(-1))))
    wrong = F.col("_m").isNull()
    for name, kind in wanted.items():
        value = F.col(f"_{name}")
        is_null = value.isNull() | F.is_variant_null(value)
        type_ok = F.schema_of_variant(value) == kind.upper()
        wrong = wrong | (~is_null & ~F.coalesce(type_ok, F.lit(False)))
    value = lambda n, kind: F.when(F.col(f"_{n}").isNull(), F.lit("" if kind == "string" else 0).cast(kind)).otherwise(F.try_variant_get(F.col(f"_{n}"), "$", kind))
    return low.select("raw", wrong.alias("wrong"), *(value(n, kind).alias(n) for n, kind in wanted.items()))


def parsed(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts as validated records, with ``raw`` and ``error``."""
    checked = validated(decoded(raw, column))
    return checked.withColumn("error", F.when(F.col("wrong"), F.lit("invalid JSON record")).otherwise(F.col("error"))).drop("wrong")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter("error is null").select(*FIELDS)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("error is not null").select("raw", "error")
