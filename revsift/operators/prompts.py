"""Prompt rendering from columns and small criteria / field tables.

Review-specific wording is data: criteria live in a table
``(review_id, kind, pos, text)`` with kind ``include`` or ``exclude``, extraction
fields in ``(review_id, pos, field, type, description)``. Each table is reduced
to one text block per review, then joined to the rows by ``review_id``; adaptive
execution broadcasts the blocks where their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D

# neutral defaults; what a review wants said is its own data
SCREENING_TASK = "Judge one study against the criteria of a review."
SCREENING_ANSWER = "Give one number from 0 to 1: how likely the study meets the criteria. Write nothing else."
EXTRACTION_TASK = "Fill in the fields below from one study. Answer with a JSON array that holds one object for each result."


def criteria_blocks(criteria: DataFrame) -> DataFrame:
    """(review_id, criteria_block): bulleted inclusion then exclusion criteria, in ``pos`` order."""
    def block(kind: str, title: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "text"))))
        lines = F.transform(items, lambda x: F.concat(F.lit("    - "), x["text"]))
        return F.concat(F.lit(title + "\n"), F.array_join(lines, "\n"))

    return criteria.groupBy("review_id").agg(
        F.concat(block("include", "Inclusion criteria:"), F.lit("\n\n"),
                 block("exclude", "Exclusion criteria:")).alias("criteria_block"))


def _nan(c: Column) -> Column:
    # a missing title or abstract prints as "nan" in a Python f-string over pandas
    return F.coalesce(c.cast("string"), F.lit("nan"))


def screening_prompt(df: DataFrame, criteria: DataFrame, title: str = "title", abstract: str = "abstract",
                     review_id: str = "review_id", out: str = "prompt") -> DataFrame:
    """Title/abstract prompt per row."""
    blocks = criteria_blocks(criteria).withColumnRenamed("review_id", review_id)
    j = df.join(blocks, review_id, "left")
    prompt = F.concat(F.lit(SCREENING_TASK + "\n\n"), F.coalesce(F.col("criteria_block"), F.lit("")),
                      F.lit("\n\nInstructions:\n" + SCREENING_ANSWER + "\n\nTitle:\n"), _nan(F.col(title)),
                      F.lit("\n\nAbstract:\n"), _nan(F.col(abstract)), F.lit("\n"))
    return j.withColumn(out, prompt).drop("criteria_block")


def fulltext_prompt(df: DataFrame, criteria: DataFrame, full_text: str = "full_text",
                    review_id: str = "review_id", max_chars: int = D.MAX_FULLTEXT_CHARS,
                    out: str = "prompt") -> DataFrame:
    """Full-text prompt; the text is cut to ``max_chars`` characters before it is embedded."""
    blocks = criteria_blocks(criteria).withColumnRenamed("review_id", review_id)
    j = df.join(blocks, review_id, "left")
    prompt = F.concat(F.lit(SCREENING_TASK + "\n\n"), F.coalesce(F.col("criteria_block"), F.lit("")),
                      F.lit("\n\nInstructions:\n" + SCREENING_ANSWER + "\n\nFull text:\n"),
                      F.substring(_nan(F.col(full_text)), 1, max_chars), F.lit("\n"))
    return j.withColumn(out, prompt).drop("criteria_block")


def field_blocks(fields: DataFrame) -> DataFrame:
    """(review_id, field_block): one ``- field (type): description`` line per field."""
    items = F.array_sort(F.collect_list(F.struct("pos", "field", "type", "description")))
    lines = F.transform(items, lambda x: F.concat(F.lit("- "), x["field"], F.lit(" ("), x["type"], F.lit("): "),
                                                  x["description"]))
    return fields.groupBy("review_id").agg(F.array_join(lines, "\n").alias("field_block"))


def extraction_prompt(df: DataFrame, fields: DataFrame, example: str, full_text: str = "full_text",
                      review_id: str = "review_id", out: str = "prompt") -> DataFrame:
    """Extraction prompt: field list, one example answer, then the study text (not truncated)."""
    blocks = field_blocks(fields).withColumnRenamed("review_id", review_id)
    j = df.join(blocks, review_id, "left")
    prompt = F.concat(F.lit(EXTRACTION_TASK + "\n\nFields:\n"), F.coalesce(F.col("field_block"), F.lit("")),
                      F.lit("\n\nExample:\n" + example + "\n\nStudy:\n"), _nan(F.col(full_text)), F.lit("\n"))
    return j.withColumn(out, prompt).drop("field_block")


def truncate_text(c, max_chars: int = D.MAX_FULLTEXT_CHARS) -> Column:
    """First ``max_chars`` characters (code points, like Python slicing)."""
    return F.substring(c if isinstance(c, Column) else F.col(c), 1, max_chars)


def first_n(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The first ``n`` rows by an explicit order (a top-n: the limit is the feature)."""
    return df.orderBy(order_col).limit(n)


def positional_rename(df: DataFrame, names: list[str]) -> DataFrame:
    """First ``len(names)`` columns by position, renamed."""
    return df.select(*[F.col(df.columns[i]).alias(n) for i, n in enumerate(names)])


def append_null_columns(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add typed NULL columns (e.g. relevance int, probability double) to be filled later."""
    for name, typ in cols.items():
        df = df.withColumn(name, F.lit(None).cast(typ))
    return df
