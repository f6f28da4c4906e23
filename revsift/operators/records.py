"""Model answers to JSON records, and record-set operations (dedup, union, intersection)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NullType, StructType, VariantType

from ..functions.text import clean_value, col_of, safe_parse_json, strip_fences

_STR = "string"


def parse_json_response(df: DataFrame, text: str = "output_text", out: str = "parsed") -> DataFrame:
    """Fence-stripped answer parsed to VARIANT (NULL when invalid), plus its kind."""
    v = safe_parse_json(text)
    kind = F.when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit("array")) \
        .when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit("object")) \
        .when(v.isNotNull(), F.lit("scalar"))
    return df.select("*", v.alias(out), kind.alias(out + "_kind"))


def flatten_records(parsed: DataFrame, id_cols: Sequence[str], v: str = "parsed") -> DataFrame:
    """One row per extracted record, keeping the answer order in ``rec_pos``.

    An array contributes each element, an object contributes itself, anything
    else (scalar, invalid, empty array/object) contributes nothing — the
    ``if data: extend/append`` rule. The answer is never split across tasks:
    one answer is one row, exploded in place (no shuffle).
    """
    val = F.col(v)
    arr = F.try_variant_get(val, "$", "array<variant>")
    obj = F.try_variant_get(val, "$", "map<string,variant>")
    items = (F.when(arr.isNotNull(), arr)
             .when(obj.isNotNull() & (F.size(obj) > 0), F.array(val))
             .otherwise(F.array().cast("array<variant>")))
    return parsed.select(*id_cols, F.posexplode(items).alias("rec_pos", "record"))


def discovered_fields(records: DataFrame, rec: str = "record", most: int = 1000) -> list[tuple[str, str]]:
    """(name, type) of every key that occurs in an object of ``rec``, by name.

    The types of all records are merged by one aggregation. A key whose values are
    all of one kind of scalar gets its type, numbers the wider one; lists, objects
    and mixed values stay VARIANT, and a key that only holds nulls is a string.
    Keys are data: more than ``most`` raise, as one row with all of them comes to
    the driver."""
    objects = records.where(F.try_variant_get(F.col(rec), "$", "map<string,variant>").isNotNull())
    told = objects.agg(F.schema_of_variant_agg(F.col(rec))).first()[0]
    if not told or not told.startswith("OBJECT<"):
        return []
    kinds = DataType.fromDDL(re.sub(r"\bOBJECT<", "STRUCT<", told))
    if len(kinds) > most:
        raise ValueError(f"{len(kinds)} different keys, more than {most}")
    nested = (ArrayType, StructType, VariantType)
    return sorted((f.name, "variant" if isinstance(f.dataType, nested) else "string" if isinstance(f.dataType, NullType) else f.dataType.simpleString()) for f in kinds)


def records_wide(records: DataFrame, fields: Sequence[tuple[str, str]] | None = None,
                 id_cols: Sequence[str] = (), rec: str = "record") -> DataFrame:
    """Records to a wide table: one column per field; missing keys are NULL.

    Fields are declared, or else those that occur (``discovered_fields``)."""
    if fields is None:
        fields = discovered_fields(records, rec)
    return records.select(*id_cols, *[F.try_variant_get(F.col(rec), f"${_path_key(name)}", typ).alias(name)
                                      for name, typ in fields])


def _path_key(name: str) -> str:
    """The step to a member in a JSON path."""
    if name and not set(name) & set(".["):
        return f".{name}"
    for quote in "'\"":
        if quote not in name:
            return f"[{quote}{name}{quote}]"
    raise ValueError(f"no path leads to a key with both kinds of quotes: {name}")


def response_audit(df: DataFrame, id_col: str, text: str = "output_text") -> DataFrame:
    """Non-empty answers: id, length and a 200-character preview."""
    t = F.col(text)
    return (df.filter(t.isNotNull() & (F.length(t) > 0))
            .select(id_col, F.length(t).alias("raw_length"), F.substring(t, 1, 200).alias("preview")))


# ---------------------------------------------------------------------------
# Keys and record sets
# ---------------------------------------------------------------------------

def variant_text(v: Column) -> Column:
    """Scalar variant as the text Python's ``str()`` gives the parsed JSON value.

    Strings come unquoted, and booleans print as in JSON (value cleaning lower-cases
    Python's ``True`` anyway). A JSON number with a fraction or exponent is a
    float in Python, so ``86.0`` prints as ``86.0``, not ``86``: decimals keep
    at least one fractional digit and drop trailing zeros. This holds within
    the usual positional range; Spark stores such numbers as DECIMAL."""
    t = F.try_variant_get(v, "$", _STR)
    is_decimal = F.startswith(F.schema_of_variant(v), F.lit("DECIMAL"))
    trimmed = F.regexp_replace(t, r"0+$", "")
    as_float = F.when(~t.contains("."), F.concat(t, F.lit(".0"))) \
        .when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    return F.when(is_decimal, as_float).otherwise(t)


def record_key(rec: Column, key_fields: Sequence[str], sep: str = "||") -> Column:
    """Cleaned key field(s) of a VARIANT record; missing or null key → ``""``."""
    parts = [clean_value(F.coalesce(variant_text(F.try_variant_get(rec, f"${_path_key(k)}", "variant")), F.lit("")))
             for k in key_fields]
    return parts[0] if len(parts) == 1 else F.concat_ws(sep, *parts)


def last_wins(df: DataFrame, key: str | Sequence[str], order_col: str) -> DataFrame:
    """Keep, per key, the row with the largest ``order_col`` (dict-building semantics).

    ``max_by`` aggregates partially on the map side, so a key holding a third of
    all rows is reduced inside each task before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.max_by(packed, F.col(order_col)).alias("_last"))
            .select(*keys, "_last.*"))


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def key_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def skip_existing(inputs: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Inputs whose key is not yet in ``done`` (incremental processing)."""
    keys = [key] if isinstance(key, str) else list(key)
    return inputs.join(done.select(*keys), keys, "left_anti")


__all__ = [
    "parse_json_response", "flatten_records", "records_wide", "response_audit", "record_key",
    "last_wins", "key_union", "key_intersection", "skip_existing", "strip_fences", "col_of",
]


def concat_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Row concatenation: columns by name, missing ones NULL, no deduplication."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
