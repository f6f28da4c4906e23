"""Pairing human and model labels, and the checks done before scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import row_index


def pair_by_key(human: DataFrame, ai: DataFrame, key: str | Sequence[str],
                truth: str = "relevance", pred: str = "relevance", keep_human: Sequence[str] = (),
                keep_ai: Sequence[str] = ()) -> DataFrame:
    """Inner equi-join of golden and predicted labels on an explicit key.

    The preferred form of pairing: a plain shuffle (or AQE broadcast) join,
    ``y_true``/``y_pred`` as the label columns; kept columns are prefixed
    ``human_`` / ``ai_`` (the false-negative list shows the golden ones)."""
    keys = [key] if isinstance(key, str) else list(key)
    h = human.select(*keys, F.col(truth).alias("y_true"), *[F.col(c).alias("human_" + c) for c in keep_human])
    a = ai.select(*keys, F.col(pred).alias("y_pred"), *[F.col(c).alias("ai_" + c) for c in keep_ai])
    return h.join(a, keys, "inner")


def pair_by_position(human: DataFrame, ai: DataFrame, human_order: Sequence,
                     ai_order: Sequence, truth: str = "relevance",
                     pred: str = "relevance", keep_human: Sequence[str] = (),
                     keep_ai: Sequence[str] = ()) -> DataFrame:
    """The i-th golden row against the i-th model row (explicit orders).

    Positions come from ``row_index`` (distributed), then an equi-join on the
    position. Rows without a partner are dropped by the inner join; call
    ``length_parity`` first to reject unequal inputs as the scripts do."""
    def cols(order, extra):
        names = [c for c in order if isinstance(c, str)]
        return list(dict.fromkeys(names + list(extra)))

    # only the ordering, label and kept columns are sorted and checkpointed
    h = row_index(human.select(*cols(human_order, [truth, *keep_human])), human_order, "pos")
    a = row_index(ai.select(*cols(ai_order, [pred, *keep_ai])), ai_order, "pos")
    h = h.select("pos", F.col(truth).cast("int").alias("y_true"),
                 *[F.col(c).alias("human_" + c) for c in keep_human])
    a = a.select("pos", F.col(pred).cast("int").alias("y_pred"),
                 *[F.col(c).alias("ai_" + c) for c in keep_ai])
    return h.join(a, "pos", "inner")


def false_negatives(paired: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Rows labelled relevant by the golden set and missed by the model."""
    return paired.filter((F.col(y_true) == 1) & (F.col(y_pred) == 0))


def length_parity(human: DataFrame, ai: DataFrame) -> DataFrame:
    """One row: both row counts and whether they agree (one pass over a union)."""
    both = human.select(F.lit(0).alias("_side")).unionAll(ai.select(F.lit(1).alias("_side")))
    counts = both.agg(F.count_if(F.col("_side") == 0).alias("n_human"),
                      F.count_if(F.col("_side") == 1).alias("n_ai"))
    return counts.select("n_human", "n_ai", (F.col("n_human") == F.col("n_ai")).alias("equal"))


def label_domain_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per label column, how many values fall outside {0, 1} (NULL counts as bad).

    The values are checked as they are, before any cast to an integer: 0.7 is
    reported, not read as 0."""
    aggs = []
    for c in cols:
        bad = F.col(c).isNull() | ~F.col(c).isin(0, 1)
        aggs.append(F.count_if(bad).alias(f"bad_{c}"))
    return df.agg(*aggs)


def assert_valid_labels(df: DataFrame, cols: Sequence[str]) -> None:
    """Raise ValueError when a label is outside {0, 1} (the scripts' runtime check)."""
    row = label_domain_check(df, cols).first()
    bad = {k: v for k, v in row.asDict().items() if v}
    if bad:
        raise ValueError(f"labels outside {{0,1}}: {bad}")


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()
