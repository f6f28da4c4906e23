"""Registered evaluation queries over the benchmark tables.

Each entry of ``QUERIES`` takes (spark, sf_dir) and returns a DataFrame built
with the library operators. ``oracle.py`` holds the independent DuckDB SQL of
the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .. import defaults as D
from ..operators import extraction as X
from ..operators import matching as M
from ..operators import metrics as MT
from ..operators import pairing as P
from ..operators import prompts as PR
from ..operators import records as R
from ..operators import scoring as SC
from ..operators import sections as SE
from . import inputs as I

QueryFn = Callable[[SparkSession, str], DataFrame]

METRIC_COLS = (["tp", "fp", "tn", "fn"] + MT.POINT_METRICS
               + [f"{n}_{e}" for n in MT.INTERVALS for e in ("low", "high")])
THRESHOLDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
SHARDS = 4
STAMPS = [0.3, 0.5, 0.8]
CHECKPOINT_EVERY = D.CHECKPOINT_EVERY_TITLE_ABSTRACT
FUZZY_THRESHOLD = D.FUZZY_THRESHOLD
LENIENT = {"type": X.TOKEN_SUBSET}
KEEP_ROLES = ["assistant", "system"]

# Criteria of the demo review (parameter table of the prompt queries).
CRITERIA = [
    ("demo", "include", 1, "The text has running sentences."),
    ("demo", "include", 2, "A part is named together with its type."),
    ("demo", "exclude", 1, "The text is a list of links."),
    ("demo", "exclude", 2, "The text repeats one line."),
]


def criteria_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CRITERIA, "review_id string, kind string, pos int, text string")


def criteria_block_text() -> str:
    """The criteria block as rendered by ``prompts.criteria_blocks`` (for the SQL oracle)."""
    inc = [t for _, k, _, t in sorted(CRITERIA, key=lambda r: r[2]) if k == "include"]
    exc = [t for _, k, _, t in sorted(CRITERIA, key=lambda r: r[2]) if k == "exclude"]
    return ("Inclusion criteria:\n" + "\n".join("    - " + t for t in inc) + "\n\n"
            + "Exclusion criteria:\n" + "\n".join("    - " + t for t in exc))


# ---------------------------------------------------------------------------
# Screening: parse → threshold → pair → metrics
# ---------------------------------------------------------------------------

def q_screening_metrics(spark, d):
    return MT.screening_metrics(I.screening_pairs(spark, d)).select(*METRIC_COLS)


def q_screening_metrics_by_lang(spark, d):
    return MT.screening_metrics(I.screening_pairs(spark, d), group_by=["lang"]).select("lang", *METRIC_COLS)


def q_confusion_counts(spark, d):
    lab = I.table(spark, d, "labels")
    return MT.confusion_counts(lab, "quality", "toxic")


def q_metric_report_long(spark, d):
    m = MT.screening_metrics(I.screening_pairs(spark, d))
    return MT.metrics_long(m)


def q_wald_intervals(spark, d):
    m = MT.screening_metrics(I.screening_pairs(spark, d), group_by=["lang"])
    cols = [f"{n}_{e}" for n in MT.INTERVALS[:5] for e in ("low", "high")]
    return m.select("lang", "tp", "fp", "tn", "fn", *cols)


def q_agresti_coull_intervals(spark, d):
    m = MT.screening_metrics(I.screening_pairs(spark, d), group_by=["lang"])
    cols = [f"{n}_{e}" for n in MT.INTERVALS[5:] for e in ("low", "high")]
    return m.select("lang", "tp", "fp", "tn", "fn", *cols)


def q_threshold_labels(spark, d):
    return I.scored_documents(spark, d).select("doc_id", "probability", "relevance")


def q_threshold_sweep(spark, d):
    pairs = I.screening_pairs(spark, d)
    return MT.threshold_sweep(pairs, THRESHOLDS).select("threshold", "tp", "fp", "tn", "fn", "recall",
                                                       "precision", "specificity", "f1", "work_saved")


def q_false_negatives(spark, d):
    return P.false_negatives(I.screening_pairs(spark, d)).select("doc_id", "lang", "probability", "y_true", "y_pred")


def q_label_domain_check(spark, d):
    return P.label_domain_check(I.raw_labels(spark, d), ["y_true", "y_pred"])


def q_distinct_labels(spark, d):
    return P.distinct_labels(I.table(spark, d, "labels"), "quality")


def q_length_parity(spark, d):
    return P.length_parity(I.table(spark, d, "labels"), I.scored_documents(spark, d))


def q_positional_pairing(spark, d):
    human = I.table(spark, d, "labels").select("doc_id", F.col("quality").alias("relevance"))
    ai = I.scored_documents(spark, d).select("doc_id", "relevance")  # more rows than labels: keys part after the first gap
    return P.pair_by_position(human, ai, ["doc_id"], ["doc_id"], keep_human=["doc_id"], keep_ai=["doc_id"])


def q_parse_probability(spark, d):
    r = I.screening_responses(spark, d)
    return r.select("doc_id", "response", T.parse_probability("response").alias("probability"))


def q_parse_binary(spark, d):
    r = I.screening_responses(spark, d)
    return r.select("doc_id", "response", T.parse_binary("response").alias("label"))


# ---------------------------------------------------------------------------
# JSON answers
# ---------------------------------------------------------------------------

def q_json_fence_parse(spark, d):
    parsed = R.parse_json_response(I.json_answers(spark, d))
    return parsed.select("event_id", T.strip_fences("output_text").alias("cleaned"),
                         F.col("parsed").isNotNull().alias("is_valid"), F.col("parsed_kind").alias("kind"))


def q_json_flatten(spark, d):
    parsed = R.parse_json_response(I.json_answers(spark, d))
    flat = R.flatten_records(parsed, ["event_id"])
    return R.records_wide(flat, [("k", "bigint")], ["event_id", "rec_pos"])


def q_response_audit(spark, d):
    return R.response_audit(I.json_answers(spark, d), "event_id")


# ---------------------------------------------------------------------------
# Candidate tables, prompts, scoring
# ---------------------------------------------------------------------------

def q_first_n_candidates(spark, d):
    c = I.candidates(spark, d)
    return PR.first_n(c, "row_id", 5).select("row_id", "title", F.length("abstract").alias("abstract_chars"))


def q_truncate_text(spark, d):
    docs = I.long_texts(spark, d, D.MAX_FULLTEXT_CHARS)
    t = PR.truncate_text("text", D.MAX_FULLTEXT_CHARS)
    return docs.select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


def q_length_stats(spark, d):
    c = I.candidates(spark, d)
    return c.groupBy("lang").agg(F.avg(F.length("title")).alias("avg_title_chars"),
                                 F.avg(F.length("abstract")).alias("avg_abstract_chars"))


def _prompts(spark, d):
    c = I.candidates(spark, d).withColumn("review_id", F.lit("demo"))
    return PR.screening_prompt(c, criteria_table(spark))


def q_render_prompt(spark, d):
    p = _prompts(spark, d)
    return p.select("row_id", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("digest"))


# Extraction fields of the demo review (parameter table of the extraction prompt).
FIELDS = [
    ("demo", 1, "part_key", "integer", "number of the part"),
    ("demo", 2, "brand", "string", "brand as printed"),
    ("demo", 3, "words", "list of strings", "words of the name"),
]
EXAMPLE = '[{"part_key": 12, "brand": "Brand#13", "words": ["blue", "lace"]}]'


def fields_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, "review_id string, pos int, field string, type string, description string")


def field_block_text() -> str:
    return "\n".join(f"- {f} ({t}): {desc}" for _, _, f, t, desc in sorted(FIELDS, key=lambda r: r[1]))


def _docs(spark, d):
    return I.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("full_text"),
                                                 F.lit("demo").alias("review_id"))


def q_render_fulltext_prompt(spark, d):
    p = PR.fulltext_prompt(_docs(spark, d), criteria_table(spark), max_chars=D.MAX_FULLTEXT_CHARS)
    return p.select("row_id", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("digest"))


def q_render_extraction_prompt(spark, d):
    p = PR.extraction_prompt(_docs(spark, d), fields_table(spark), EXAMPLE)
    return p.select("row_id", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("digest"))


def _scored(spark, d):
    return SC.score_rows(_prompts(spark, d), I.demo_scorer, "row_id", "prompt")


def q_score_batch(spark, d):
    return _scored(spark, d)


def q_error_classes(spark, d):
    dl = SC.dead_letter(_scored(spark, d))
    return dl.groupBy("error_class").agg(F.count(F.lit(1)).alias("failed"))


def q_dead_letter(spark, d):
    return SC.dead_letter(_scored(spark, d))


def q_shard_round_robin(spark, d):
    return SC.assign_shards(I.candidates(spark, d).select("row_id"), ["row_id"], SHARDS)


def q_token_totals(spark, d):
    return SC.token_totals(_scored(spark, d))


def q_token_running(spark, d):
    run = SC.running_tokens(_scored(spark, d), ["row_id"])
    return run.select("row_id", "completed", "cum_input_tokens", "cum_output_tokens", "cum_total_tokens")


def q_checkpoint_rows(spark, d):
    run = SC.running_tokens(_scored(spark, d), ["row_id"])
    return SC.checkpoint_rows(run, CHECKPOINT_EVERY).select("row_id", "completed", "cum_total_tokens")


def q_csv_candidates(spark, d):
    """Candidates written as CSV (quotes, embedded newlines) and read back by position."""
    from ..session import scratch_path
    from ..sources import readers, sinks
    path = scratch_path(spark, "csv-candidates")
    docs = I.table(spark, d, "documents").select(F.substring_index("text", "\n", 1).alias("Title"),
                                                  F.col("text").alias("Abstract"), "doc_id")
    sinks.write_csv(docs.orderBy("doc_id").select("Title", "Abstract"), path)
    c = readers.read_candidates(spark, path)
    return c.select("row_id", F.length("title").alias("title_chars"), F.length("abstract").alias("abstract_chars"),
                    F.md5("abstract").alias("digest"))


def q_skip_existing(spark, d):
    inputs = I.table(spark, d, "documents").select("doc_id")
    done = I.table(spark, d, "labels").select("doc_id")
    return R.skip_existing(inputs, done, "doc_id")


# ---------------------------------------------------------------------------
# Normalisation
# ---------------------------------------------------------------------------

def q_clean_values(spark, d):
    docs = I.table(spark, d, "documents")
    c = T.clean_value("text")
    return docs.select("doc_id", F.length(c).alias("chars"), F.md5(c).alias("digest"))


def q_normalize_doi(spark, d):
    pages = I.table(spark, d, "pages")
    return pages.select("page_id", T.normalize_doi("url").alias("doi_norm"))


def q_normalize_title(spark, d):
    c = I.candidates(spark, d)
    return c.select("row_id", T.normalize_title("title").alias("title_norm"))


def q_normalize_list(spark, d):
    p = I.table(spark, d, "part")
    return p.select("p_partkey", F.to_json(T.clean_list(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")))
                    .alias("tokens"))


# ---------------------------------------------------------------------------
# Extraction agreement
# ---------------------------------------------------------------------------

KEY = ["p_partkey"]


def _cells(spark, d, comparators=None):
    h = X.latest_records(I.golden_records(spark, d), KEY)
    a = X.latest_records(I.ai_records(spark, d), KEY)
    return X.compare_records(h, a, KEY, comparators)


def _keys(records: DataFrame) -> DataFrame:
    return records.select(R.record_key(F.col("record"), KEY).alias("record_id"))


def q_dedup_last_wins(spark, d):
    a = I.ai_records(spark, d)
    keyed = a.select(R.record_key(F.col("record"), KEY).alias("record_id"), "rec_pos",
                     F.try_variant_get("record", "$.type", "string").alias("type"))
    return R.last_wins(keyed, "record_id", "rec_pos")


def q_key_union(spark, d):
    return R.key_union(_keys(I.golden_records(spark, d)), _keys(I.ai_records(spark, d)), "record_id")


def q_key_intersection(spark, d):
    return R.key_intersection(_keys(I.golden_records(spark, d)), _keys(I.ai_records(spark, d)), "record_id")


def q_extraction_cells(spark, d):
    return _cells(spark, d)


def q_extraction_metrics(spark, d):
    return X.extraction_metrics(_cells(spark, d)).select(*METRIC_COLS)


def q_extraction_errors(spark, d):
    return X.extraction_errors(_cells(spark, d))


def q_error_preview(spark, d):
    return X.error_preview(_cells(spark, d), 5)


def q_field_accuracy(spark, d):
    return X.field_accuracy(_cells(spark, d))


def q_study_accuracy(spark, d):
    return X.study_accuracy(_cells(spark, d))


def q_extraction_coverage(spark, d):
    return X.coverage(_keys(I.golden_records(spark, d)), _keys(I.ai_records(spark, d)))


def q_extraction_counts(spark, d):
    return X.extraction_counts(_keys(I.golden_records(spark, d)), _keys(I.ai_records(spark, d)), _cells(spark, d))


def q_extraction_lenient(spark, d):
    return X.field_accuracy(_cells(spark, d, LENIENT))


# ---------------------------------------------------------------------------
# Match cascade
# ---------------------------------------------------------------------------

def _cascade(spark, d, fuzzy=True):
    return M.match_cascade(I.ai_papers(spark, d), I.golden_papers(spark, d), "ai_id", "title", "relevance",
                           "title", golden_doi="doi", threshold=FUZZY_THRESHOLD, fuzzy=fuzzy)


def q_doi_match(spark, d):
    return _cascade(spark, d, fuzzy=False).where(F.col("match_kind") == "id").select("ai_id", "doi_norm")


def q_title_match(spark, d):
    return _cascade(spark, d, fuzzy=False).where(F.col("match_kind") == "exact").select("ai_id", "title_norm")


def q_fuzzy_match(spark, d):
    return _cascade(spark, d).where(F.col("match_kind") == "fuzzy").select("ai_id", "title_sorted")


def q_match_cascade(spark, d):
    return _cascade(spark, d).select("ai_id", "match_kind", "y_true", "y_pred")


def q_fuzzy_metrics(spark, d):
    counts = M.cascade_counts(_cascade(spark, d), I.golden_papers(spark, d))
    return MT.metrics_from_counts(counts).select(*METRIC_COLS, "padding")


def q_unmatched_padding(spark, d):
    g = I.golden_papers(spark, d)
    m, un = M.match_both(I.ai_papers(spark, d), g, "ai_id", "title", "relevance", "title", golden_doi="doi", threshold=FUZZY_THRESHOLD)
    return M.cascade_counts(m, g, un).select("padding", "matched", "n_golden", "unmatched_human")


def q_false_negatives_ai(spark, d):
    m = _cascade(spark, d)
    return P.false_negatives(m).select("ai_id", "title")


# ---------------------------------------------------------------------------
# Sections
# ---------------------------------------------------------------------------

def q_split_lines(spark, d):
    docs = I.table(spark, d, "documents")
    return SE.explode_lines(docs, "doc_id", "text").select("doc_id", "line_no", F.length("line").alias("chars"))


def q_detect_headers(spark, d):
    return SE.header_lines(I.papers_markdown(spark, d), "doc_id", "text")


def q_drop_sections(spark, d):
    docs = SE.drop_sections(I.papers_markdown(spark, d), "text", "out")
    return docs.select("doc_id", F.length("out").alias("chars"), F.md5("out").alias("digest"))


def q_drop_sections_markdown(spark, d):
    md = SE.drop_sections(I.conversation_markdown(spark, d), "text", "out", ["system"])
    return md.select("conv_id", F.length("out").alias("chars"), F.md5("out").alias("digest"))


def q_keep_sections(spark, d):
    md = SE.keep_sections(I.conversation_markdown(spark, d), "text", "out", KEEP_ROLES)
    return md.select("conv_id", F.length("out").alias("chars"), F.md5("out").alias("digest"))


def q_stream_confusion(spark, d):
    from ..streaming.confusion import stream_confusion_counts
    return stream_confusion_counts(spark, d)


# ---------------------------------------------------------------------------
# Sources and sinks, written and read back
# ---------------------------------------------------------------------------
def _there_and_back(spark, name):
    from ..session import scratch_path
    from ..sources import readers, sinks
    return scratch_path(spark, name), readers, sinks


def q_semicolon_csv(spark, d):
    path, readers, sinks = _there_and_back(spark, "semicolon-csv")
    sinks.write_semicolon_csv(I.table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    back = readers.read_table_csv(spark, path, "conv_id long, turn long, role string, text string", sep=";")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def q_json_records(spark, d):
    path, readers, sinks = _there_and_back(spark, "json-records")
    part = I.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.split("p_type", " ").alias("words"))
    sinks.write_json_arrays(part, path, "p_partkey", per_file=500)
    rec = readers.read_json_records(spark, path)
    get = lambda f, t: F.try_variant_get("record", f"$.{f}", t).alias(f)
    return rec.select("rec_pos", get("p_partkey", "bigint"), get("p_name", "string"), get("p_size", "int"),
                      F.try_variant_get("record", "$.words[0]", "string").alias("first_word"))


def q_json_lines(spark, d):
    path, _, sinks = _there_and_back(spark, "json-lines")
    sinks.write_json(I.table(spark, d, "pages").select("page_id", "url", "html"), path)
    return spark.read.schema("page_id long, url string, html string").json(path).select("page_id", "url", F.md5("html").alias("digest"))


def q_null_columns(spark, d):
    c = PR.append_null_columns(I.candidates(spark, d).select("row_id"), {"relevance": "int", "probability": "double"})
    return c.select("row_id", F.col("relevance").isNull().alias("no_relevance"), F.col("probability").isNull().alias("no_probability"))


def q_concat_rows(spark, d):
    parts = I.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    makers = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return R.concat_rows(parts, makers).select("key", "name", "size", "balance")


def q_threshold_files(spark, d):
    path, _, sinks = _there_and_back(spark, "by-threshold")
    scored = I.scored_documents(spark, d).select("doc_id", "probability", F.explode(F.array(*[F.lit(t) for t in STAMPS])).alias("threshold"))
    stamped = scored.select("doc_id", "threshold", F.when(F.col("probability") >= F.col("threshold"), 1).otherwise(0).alias("relevance"))
    sinks.write_by_threshold(stamped, path)
    return spark.read.schema("doc_id long, relevance int, threshold double").option("header", True).csv(path).select("doc_id", "threshold", "relevance")


def q_extraction_status(spark, d):
    _, _, sinks = _there_and_back(spark, "status")
    found = R.flatten_records(R.parse_json_response(I.json_answers(spark, d)), ["event_id"])
    none = found.where("rec_pos < 0")
    return sinks.extraction_status(found).withColumn("run", F.lit("all")).unionByName(sinks.extraction_status(none).withColumn("run", F.lit("none")))


def q_raw_responses(spark, d):
    path, _, sinks = _there_and_back(spark, "raw-responses")
    sinks.write_raw_responses(_scored(spark, d), path)
    return spark.read.parquet(path).select("row_id", "output_text", T.parse_probability("output_text").alias("probability"))


def q_metric_report_text(spark, d):
    path, _, sinks = _there_and_back(spark, "report")
    m = MT.screening_metrics(I.screening_pairs(spark, d))
    lines = sinks.confusion_lines(m).unionByName(sinks.report_lines(m))
    lines.repartition(1).sortWithinPartitions("ord").select("line").write.text(path)  # twenty-six lines
    return spark.read.text(path).select(F.col("value").alias("line"))


def q_extraction_report_text(spark, d):
    _, _, sinks = _there_and_back(spark, "report")
    return sinks.extraction_lines(_cells(spark, d)).select("ord", "line")


def q_retry_failed(spark, d):
    return SC.retry_failed(_scored(spark, d), _prompts(spark, d), I.recovered_scorer)


def q_score_resume(spark, d):
    """A run that ended half-way is taken up again: what its table holds is not asked for twice."""
    path, _, _ = _there_and_back(spark, "scored-table")
    prompts = _prompts(spark, d)
    SC.score_to_table(prompts.where("row_id % 2 = 0"), I.demo_scorer, path)
    return SC.score_to_table(prompts, I.recovered_scorer, path, blocks=2, rounds=1)


def q_wss_at_recall(spark, d):
    return MT.wss_at_recall(I.screening_pairs(spark, d), [0.8, 0.9, 0.95, 1.0])


def _document_folder(spark, d):
    from ..sources.files import write_named_files
    path, readers, _ = _there_and_back(spark, "document-folder")
    write_named_files(I.document_files(spark, d), path)
    return path, readers


def q_markdown_folder(spark, d):
    """Documents written as files, UTF-8 or Latin-1, and read back as (title, text)."""
    path, readers = _document_folder(spark, d)
    docs = readers.read_markdown_dir(spark, path)
    return docs.select("title", F.length("full_text").cast("long").alias("chars"), F.md5(F.encode("full_text", "UTF-8")).alias("digest"))


def q_latin1_documents(spark, d):
    """Of the documents read back, those that hold other than ASCII characters."""
    path, readers = _document_folder(spark, d)
    other = F.regexp_replace("full_text", r"[\x00-\x7F]", "")
    docs = readers.read_markdown_dir(spark, path).select("title", other.alias("other")).where("other <> ''")
    return docs.select("title", F.length("other").cast("long").alias("n_other"), F.md5(F.encode("other", "UTF-8")).alias("digest"))


def q_document_listing(spark, d):
    """The files as a listing: stem and length, without those done already; files of no bytes are passed over."""
    path, readers = _document_folder(spark, d)
    listed = readers.list_documents(spark, path, "*.[mM][dD]")
    done = I.table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("stem"))
    return readers.pending_documents(listed, done).select("stem", "length")


def q_records_wide(spark, d):
    """Records as a wide table whose fields are found in them."""
    wide = R.records_wide(I.ai_records(spark, d), id_cols=["rec_pos"])
    words = F.array_join(F.try_variant_get("words", "$", "array<string>"), " ")
    return wide.select("rec_pos", "p_partkey", "name", "brand", "type", "size", words.alias("words"))


QUERIES: dict[str, QueryFn] = {
    "markdown_folder": q_markdown_folder,
    "latin1_documents": q_latin1_documents,
    "document_listing": q_document_listing,
    "records_wide": q_records_wide,
    "screening_metrics": q_screening_metrics,
    "screening_metrics_by_lang": q_screening_metrics_by_lang,
    "confusion_counts": q_confusion_counts,
    "metric_report_long": q_metric_report_long,
    "wald_intervals": q_wald_intervals,
    "agresti_coull_intervals": q_agresti_coull_intervals,
    "threshold_labels": q_threshold_labels,
    "threshold_sweep": q_threshold_sweep,
    "false_negatives": q_false_negatives,
    "label_domain_check": q_label_domain_check,
    "distinct_labels": q_distinct_labels,
    "length_parity": q_length_parity,
    "positional_pairing": q_positional_pairing,
    "parse_probability": q_parse_probability,
    "parse_binary": q_parse_binary,
    "json_fence_parse": q_json_fence_parse,
    "json_flatten": q_json_flatten,
    "response_audit": q_response_audit,
    "first_n_candidates": q_first_n_candidates,
    "truncate_text": q_truncate_text,
    "length_stats": q_length_stats,
    "render_prompt": q_render_prompt,
    "render_fulltext_prompt": q_render_fulltext_prompt,
    "render_extraction_prompt": q_render_extraction_prompt,
    "score_batch": q_score_batch,
    "error_classes": q_error_classes,
    "dead_letter": q_dead_letter,
    "shard_round_robin": q_shard_round_robin,
    "token_totals": q_token_totals,
    "token_running": q_token_running,
    "checkpoint_rows": q_checkpoint_rows,
    "csv_candidates": q_csv_candidates,
    "skip_existing": q_skip_existing,
    "clean_values": q_clean_values,
    "normalize_doi": q_normalize_doi,
    "normalize_title": q_normalize_title,
    "normalize_list": q_normalize_list,
    "dedup_last_wins": q_dedup_last_wins,
    "key_union": q_key_union,
    "key_intersection": q_key_intersection,
    "extraction_cells": q_extraction_cells,
    "extraction_metrics": q_extraction_metrics,
    "extraction_errors": q_extraction_errors,
    "error_preview": q_error_preview,
    "field_accuracy": q_field_accuracy,
    "study_accuracy": q_study_accuracy,
    "extraction_coverage": q_extraction_coverage,
    "extraction_counts": q_extraction_counts,
    "extraction_lenient": q_extraction_lenient,
    "doi_match": q_doi_match,
    "title_match": q_title_match,
    "fuzzy_match": q_fuzzy_match,
    "match_cascade": q_match_cascade,
    "fuzzy_metrics": q_fuzzy_metrics,
    "unmatched_padding": q_unmatched_padding,
    "false_negatives_ai": q_false_negatives_ai,
    "split_lines": q_split_lines,
    "detect_headers": q_detect_headers,
    "drop_sections": q_drop_sections,
    "drop_sections_markdown": q_drop_sections_markdown,
    "keep_sections": q_keep_sections,
    "stream_confusion": q_stream_confusion,
    "semicolon_csv": q_semicolon_csv,
    "json_records": q_json_records,
    "json_lines": q_json_lines,
    "null_columns": q_null_columns,
    "concat_rows": q_concat_rows,
    "threshold_files": q_threshold_files,
    "extraction_status": q_extraction_status,
    "raw_responses": q_raw_responses,
    "metric_report_text": q_metric_report_text,
    "extraction_report_text": q_extraction_report_text,
    "retry_failed": q_retry_failed,
    "score_resume": q_score_resume,
    "wss_at_recall": q_wss_at_recall,
}
