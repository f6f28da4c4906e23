"""Removal of repeated lines (operator 10).

A text's units are its lines. Each unit is normalised (lower case, runs of
white space as one space, none at the ends) and hashed to 128 bits. All units
of one digest form a group; the occurrence that comes first, by document id and
then by place, stays, and the others are removed. The removed places are
reported as code points of the original text, end exclusive, without the line
end.

Defined cases: units without a character but white space are never removed; a
null or empty text has none. Null ids rank last. Rows with the same id and the
same text are one document and get the same result; a null text is given back
as null. Other columns pass through, but for those named like the results,
which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import SPACE, let, whole_text, written


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), SPACE, " "))


def line_starts(lines: Column) -> Column:
    """Where each line starts, in code points."""
    from revsift.llm.pii import starts

    return starts(F.transform(lines, lambda x: F.length(x) + 1))


def remove_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left, ``n_units``, ``n_removed`` and ``removed``, an array of (start, end)."""
    rest = [c for c in docs.columns if c not in {"n_units", "n_removed", "removed"}]
    text = whole_text(text_col)
    # what tells documents apart: the id and the whole text
    key = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.md5(text).alias("_text")]
    lines = F.split(text, "\n")
    units = let(lines, lambda ls: let(line_starts(ls), lambda at: F.transform(ls, lambda u, i: let(normalised(u), lambda n: F.struct(
        i.alias("place"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(u)).alias("end"),
        (n == "").alias("blank"), F.xxhash64(n).alias("d1"), F.xxhash64(F.lit("second"), n).alias("d2"))))))
    each = written(docs.select(F.col(id_col).isNull().alias("_last"), F.col(id_col).alias("_rank"), *key, F.inline(units)).where("NOT blank").drop("blank"), "units")
    # written before it is joined back: the join then deals both sides anew, and a hot line can be split
    first = written(each.groupBy("d1", "d2").agg(F.min(F.struct("_last", "_rank", "_text", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("d1", "d2", "first"), "first-units")
    mine = F.struct("_last", "_rank", "_text", "place")
    gone = (each.join(first, ["d1", "d2"]).where(~mine.eqNullSafe(F.col("first")))
            .groupBy("_id", "_text").agg(F.sort_array(F.collect_set(F.struct("place", "start", "end"))).alias("_gone")))  # at most a document's lines
    kept = lambda ls: F.array_join(F.transform(F.array_except(
        F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone.place")), lambda i: F.get(ls, i)), "\n")
    found = docs.select(*rest, *key).join(gone, ["_id", "_text"], "left")
    return found.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(let(lines, kept)).alias(c) if c == text_col else F.col(c) for c in rest],
        F.size(F.filter(lines, lambda u: normalised(u) != "")).cast("long").alias("n_units"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.transform("_gone", lambda s: F.struct(s["start"], s["end"])), F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))
