"""Field-by-field agreement between golden and extracted records.

Records are VARIANT objects. Each side is keyed and deduplicated (last row
wins); one full outer join on the key yields the union of records, and each
joined pair is exploded over the union of its fields. Values are compared on a
canonical string:

* scalar → ``s:`` + cleaned text; missing key and JSON null → ``s:``
* array → ``a:`` + JSON of the sorted cleaned elements

so that ``[]`` differs from a missing field and a list never equals a scalar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_array, clean_value
from .metrics import metrics_from_counts
from .records import last_wins, record_key, variant_text

EXACT = "exact"
TOKEN_SUBSET = "token_subset"


def canonical_value(v: Column) -> Column:
    """Canonical comparison form of one VARIANT field value (see module doc)."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    elems = clean_array(F.transform(arr, lambda x: F.coalesce(variant_text(x), F.lit("None"))))
    as_list = F.concat(F.lit("a:"), F.to_json(F.array_sort(elems)))
    as_scalar = F.concat(F.lit("s:"), F.coalesce(clean_value(variant_text(v)), F.lit("")))
    return F.when(arr.isNotNull(), as_list).otherwise(as_scalar)


def _tokens(c: Column) -> Column:
    body = F.substring(c, 3, 1 << 30)
    return F.filter(F.split(body, " ", -1), lambda t: t != "")


def _correct(hv: Column, av: Column, field: Column, comparators: Mapping[str, str] | None) -> Column:
    correct = hv == av
    lenient = [f for f, kind in (comparators or {}).items() if kind == TOKEN_SUBSET]
    if lenient:
        th, ta = _tokens(hv), _tokens(av)
        contained = (F.size(F.array_except(th, ta)) == 0) | (F.size(F.array_except(ta, th)) == 0)
        correct = F.when(field.isin(*lenient), correct | contained).otherwise(correct)
    return correct


def latest_records(records: DataFrame, key_fields: Sequence[str], pos: str = "rec_pos",
                   rec: str = "record") -> DataFrame:
    """(record_id, fields MAP<STRING, VARIANT>): keyed records, last one per key.

    The output is hash-partitioned by ``record_id`` (the last-wins aggregate),
    which the record join below reuses."""
    keyed = records.select(record_key(F.col(rec), key_fields).alias("record_id"),
                           F.col(pos).alias("_pos"),
                           F.try_variant_get(F.col(rec), "$", "map<string,variant>").alias("fields"))
    return last_wins(keyed, "record_id", "_pos").select("record_id", "fields")


def compare_records(human: DataFrame, ai: DataFrame, skip: Sequence[str] = (),
                    comparators: Mapping[str, str] | None = None) -> DataFrame:
    """Cell table from two ``latest_records`` tables.

    One full outer join on ``record_id`` (both sides already partitioned by
    it, so no further exchange); each joined row is exploded over the union of
    its two field sets, and the values are canonicalised after the explode.
    """
    h = human.select("record_id", F.col("fields").alias("hf"))
    a = ai.select("record_id", F.col("fields").alias("af"))
    j = h.join(a, "record_id", "full_outer")
    empty = F.array().cast("array<string>")
    names = F.array_union(F.coalesce(F.map_keys("hf"), empty), F.coalesce(F.map_keys("af"), empty))
    if skip:
        names = F.array_except(names, F.array(*[F.lit(x) for x in skip]))
    cells = j.select("record_id", "hf", "af", F.explode(names).alias("field"))
    hv = canonical_value(F.try_element_at(F.col("hf"), F.col("field")))
    av = canonical_value(F.try_element_at(F.col("af"), F.col("field")))
    cells = cells.select(F.col("record_id").alias("record"), "field", hv.alias("_h"), av.alias("_a"))
    return cells.select("record", "field", F.substring("_h", 3, 1 << 30).alias("human"),
                        F.substring("_a", 3, 1 << 30).alias("ai"),
                        _correct(F.col("_h"), F.col("_a"), F.col("field"), comparators).alias("correct"))


def extraction_metrics(cells: DataFrame) -> DataFrame:
    """All-ones truth: TP = correct cells, FN = wrong cells, FP = TN = 0."""
    counts = cells.agg(F.count_if(F.col("correct")).alias("tp"),
                       F.lit(0).cast("bigint").alias("fp"),
                       F.lit(0).cast("bigint").alias("tn"),
                       F.count_if(~F.col("correct")).alias("fn"))
    return metrics_from_counts(counts)


def field_accuracy(cells: DataFrame) -> DataFrame:
    """Share of correct cells per field, best first."""
    return (cells.groupBy("field").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))
            .orderBy(F.desc("accuracy"), "field"))


def study_accuracy(cells: DataFrame) -> DataFrame:
    """Share of records whose every compared field is correct (two-level aggregate)."""
    per_record = cells.groupBy("record").agg(F.bool_and("correct").alias("_all"))
    return per_record.agg(F.avg(F.col("_all").cast("int")).alias("study_accuracy"),
                          F.count(F.lit(1)).alias("records"))


def coverage(human_keys: DataFrame, ai_keys: DataFrame, key: str = "record_id") -> DataFrame:
    """Matched keys over golden keys, from one full outer join of the distinct keys."""
    h = human_keys.select(key).distinct().withColumn("_h", F.lit(True))
    a = ai_keys.select(key).distinct().withColumn("_a", F.lit(True))
    j = h.join(a, key, "full_outer")
    return j.agg(F.count_if(F.col("_h")).alias("human_records"),
                 F.count_if(F.col("_a")).alias("ai_records"),
                 F.count(F.lit(1)).alias("union_records"),
                 F.count_if(F.col("_h") & F.col("_a")).alias("matched_records")) \
        .withColumn("coverage", F.try_divide(F.col("matched_records").cast("double"),
                                             F.col("human_records").cast("double")))


def extraction_counts(human_keys: DataFrame, ai_keys: DataFrame, cells: DataFrame,
                      key: str = "record_id") -> DataFrame:
    """The run's row counts in one row: records loaded per side (one key row per
    loaded record), distinct entries, union, matched, compared cells and errors.

    Keys are aggregated once, by key with a count for each side, and cells on
    their own; two single rows are put together."""
    tagged = human_keys.select(F.col(key).cast("string").alias("_k"), F.lit(1).alias("_h"), F.lit(0).alias("_a")).unionAll(
        ai_keys.select(F.col(key).cast("string").alias("_k"), F.lit(0).alias("_h"), F.lit(1).alias("_a")))
    per_key = tagged.groupBy("_k").agg(F.sum("_h").alias("h"), F.sum("_a").alias("a"))
    known = F.col("_k").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    keys = per_key.agg(zero(F.sum("h")).alias("human_loaded"), zero(F.sum("a")).alias("ai_loaded"),
                       F.count_if(known & (F.col("h") > 0)).alias("human_records"), F.count_if(known & (F.col("a") > 0)).alias("ai_records"),
                       F.count_if(known).alias("union_records"), F.count_if(known & (F.col("h") > 0) & (F.col("a") > 0)).alias("matched_records"))
    compared = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("correct")).alias("errors"))
    return keys.withColumn("_one", F.lit(1)).join(compared.withColumn("_one", F.lit(1)), "_one").drop("_one")


def extraction_errors(cells: DataFrame) -> DataFrame:
    return cells.filter(~F.col("correct"))


def error_preview(cells: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` wrong cells by (record, field) — a top-k, so the limit is the feature."""
    return extraction_errors(cells).orderBy("record", "field").limit(n)
