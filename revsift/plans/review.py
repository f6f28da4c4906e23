"""End-to-end review plans composed from the operators (one lazy plan each).

* title/abstract: prompt → score → parse → threshold
* full text: drop sections → prompt (truncated) → score → parse → threshold
* evaluation of screening by key, by position, or by the match cascade
* evaluation of extraction records field by field

The scored table is the expensive, non-deterministic step: callers should
write it (``sinks.write_raw_responses``) before parsing, as the plans below do
when given ``raw_path``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_probability
from .. import defaults as D
from ..operators import extraction as X
from ..operators import matching as M
from ..operators import metrics as MT
from ..operators import pairing as P
from ..operators import prompts as PR
from ..operators import scoring as SC
from ..operators import sections as SE
from ..sources import sinks


def _score_and_label(prompts: DataFrame, scorer, threshold: float, raw_path: str | None,
                     partitions: int | None, keep: Sequence[str]) -> DataFrame:
    scored = SC.score_rows(prompts, scorer, "row_id", "prompt", partitions, keep)
    if raw_path:
        sinks.write_raw_responses(scored, raw_path, mode="overwrite")
        scored = prompts.sparkSession.read.parquet(raw_path)
    p = parse_probability(F.col("output_text"))
    return scored.withColumn("probability", p).withColumn("relevance", MT.threshold_label(p, threshold))


def screen_title_abstract(candidates: DataFrame, criteria: DataFrame, scorer, threshold: float = D.THRESHOLD,
                          raw_path: str | None = None, partitions: int | None = None) -> DataFrame:
    """candidates(row_id, title, abstract, review_id) → scored rows with probability and relevance."""
    prompts = PR.screening_prompt(candidates, criteria)
    return _score_and_label(prompts, scorer, threshold, raw_path, partitions, ["title"])


def screen_full_text(docs: DataFrame, criteria: DataFrame, scorer, threshold: float = D.THRESHOLD,
                     drop: Sequence[str] = SE.DEFAULT_DROP, max_chars: int = D.MAX_FULLTEXT_CHARS,
                     raw_path: str | None = None, partitions: int | None = None) -> DataFrame:
    """docs(row_id, title, full_text, review_id) → cleaned, truncated, scored, labelled rows."""
    cleaned = SE.drop_sections(docs, "full_text", "_clean", drop).drop("full_text") \
        .withColumnRenamed("_clean", "full_text")
    prompts = PR.fulltext_prompt(cleaned, criteria, max_chars=max_chars)
    return _score_and_label(prompts, scorer, threshold, raw_path, partitions, ["title"])


@dataclass
class ScreeningReport:
    paired: DataFrame
    metrics: DataFrame
    false_negatives: DataFrame


def evaluate_by_key(ai: DataFrame, golden: DataFrame, key: str | Sequence[str],
                    truth: str = "relevance", pred: str = "relevance") -> ScreeningReport:
    keys = [key] if isinstance(key, str) else list(key)
    keep = [c for c in golden.columns if c not in keys and c != truth]
    paired = P.pair_by_key(golden, ai, key, truth, pred, keep_human=keep)
    return ScreeningReport(paired, MT.screening_metrics(paired), P.false_negatives(paired))


def evaluate_by_position(ai: DataFrame, golden: DataFrame, ai_order: Sequence, golden_order: Sequence,
                         truth: str = "relevance", pred: str = "relevance", check: bool = True) -> ScreeningReport:
    """Positional pairing with the scripts' checks: equal lengths and labels in {0, 1}."""
    if check:
        parity = P.length_parity(golden, ai).first()
        if not parity.equal:
            raise ValueError(f"golden has {parity.n_human} rows, model output {parity.n_ai}")
        P.assert_valid_labels(golden, [truth])
        P.assert_valid_labels(ai, [pred])
    paired = P.pair_by_position(golden, ai, golden_order, ai_order, truth, pred)
    return ScreeningReport(paired, MT.screening_metrics(paired), P.false_negatives(paired))


def evaluate_with_cascade(ai: DataFrame, golden: DataFrame, ai_id: str = "row_id", ai_title: str = "title",
                          ai_pred: str = "relevance", golden_title: str = "title",
                          golden_doi: str | None = None, threshold: int = D.FUZZY_THRESHOLD) -> ScreeningReport:
    """Full-text evaluation against an all-relevant golden list (id → exact → fuzzy title)."""
    matched, unmatched = M.match_both(ai, golden, ai_id, ai_title, ai_pred, golden_title, golden_doi, threshold=threshold)
    counts = M.cascade_counts(matched, golden, unmatched)
    return ScreeningReport(matched, MT.metrics_from_counts(counts), P.false_negatives(matched))


@dataclass
class ExtractionReport:
    cells: DataFrame
    metrics: DataFrame
    field_accuracy: DataFrame
    study_accuracy: DataFrame
    coverage: DataFrame
    errors: DataFrame


def evaluate_extraction(golden: DataFrame, ai: DataFrame, key_fields: Sequence[str],
                        ignore: Sequence[str] = (), comparators: Mapping[str, str] | None = None,
                        persist: bool = True, skip_fields: Sequence[str] | None = None) -> ExtractionReport:
    """golden/ai: (rec_pos, record VARIANT) tables. The cell table feeds five outputs, so it is
    materialised once (reliable checkpoint in the shared checkpoint folder).

    Fields not compared default to the key fields plus ``ignore``; ``skip_fields``
    replaces that list (a key field can then still be scored as a field)."""
    from ..operators.records import record_key

    h = X.latest_records(golden, key_fields)
    a = X.latest_records(ai, key_fields)
    skip = list(skip_fields) if skip_fields is not None else list(key_fields) + list(ignore)
    cells = X.compare_records(h, a, skip, comparators)
    if persist:
        cells = cells.checkpoint(eager=True)
    hk = golden.select(record_key(F.col("record"), key_fields).alias("record_id"))
    ak = ai.select(record_key(F.col("record"), key_fields).alias("record_id"))
    return ExtractionReport(cells, X.extraction_metrics(cells), X.field_accuracy(cells), X.study_accuracy(cells),
                            X.coverage(hk, ak), X.extraction_errors(cells))
