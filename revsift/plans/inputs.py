"""Evaluation inputs derived from the benchmark tables.

The driver tables hold no model output, so the model side is derived from them
deterministically with integer arithmetic (the same rules are written in SQL in
``oracle.py``). Everything is computed by Spark from the whole tables, so the
work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_probability
from ..operators.metrics import threshold_label

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k(doc_id: Column, n_chars: Column) -> Column:
    return (doc_id * 37 + n_chars) % 100


# fixed values: answers at the edges of the parsing rules
EDGE_ANSWERS = ["10", "100%", ".85", ".05", "1.5", "0,85", "-0.5", "x0.9", "00.85", "about 2 of 10: 0.9", "2", "", "0.", "11", "21", "1 of 2", "0.5/1.0", "A1", "1st", "N/A", " 0.7\n", "1.00"]


def screening_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, n_chars, response): a model answer per document.

    Answers are a bare score, a score before or behind the text that was judged, one
    with nothing but that text, or one at the edge of the parsing rules."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    score = F.lpad(((F.col("doc_id") * 7919 + F.col("n_chars") * 104729) % 1000000).cast("string"), 6, "0")
    m, text = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    edge = F.get(F.array(*[F.lit(x) for x in EDGE_ANSWERS]), (F.floor(F.col("doc_id") / 6) % len(EDGE_ANSWERS)).cast("int"))
    resp = (F.when(m == 0, F.concat(F.lit("0."), score))
            .when(m == 1, F.concat(F.lit("Confidence: 0."), score, F.lit("\n"), text))
            .when(m == 2, F.when(_k(F.col("doc_id"), F.col("n_chars")) % 2 == 0, F.lit("1")).otherwise(F.lit("0")))
            .when(m == 3, F.concat(text, F.lit("\nProbability: 0."), score))
            .when(m == 4, F.concat(text, F.lit("\n"), edge))
            .otherwise(edge))
    return d.select("doc_id", "lang", "n_chars", resp.alias("response"))


def scored_documents(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Answers parsed to a probability and thresholded to a label."""
    r = screening_responses(spark, sf_dir)
    p = parse_probability(F.col("response"))
    return r.select("doc_id", "lang", "response", p.alias("probability"),
                    threshold_label(p, threshold).alias("relevance"))


def screening_pairs(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Labels (truth = quality) joined with the model label on doc_id."""
    s = scored_documents(spark, sf_dir, threshold)
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"))
    return s.join(lab, "doc_id").select("doc_id", "lang", "probability", "y_true",
                                        F.col("relevance").alias("y_pred"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title/abstract candidates: row_id = doc_id, title = first line, abstract = whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.substring_index("text", "\n", 1).alias("title"),
                    F.col("text").alias("abstract"), "lang")


# ---------------------------------------------------------------------------
# Extraction records from `part`
# ---------------------------------------------------------------------------

def _record(key: Column, name: Column, brand: Column, typ: Column, size: Column, words: Column) -> Column:
    return F.to_variant_object(F.struct(key.alias("p_partkey"), name.alias("name"), brand.alias("brand"),
                                        typ.alias("type"), size.alias("size"), words.alias("words")))


def golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_pos, record): one golden VARIANT record per part."""
    p = table(spark, sf_dir, "part")
    rec = _record(F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type"),
                  F.col("p_size"), F.split("p_name", " "))
    return p.select(F.col("p_partkey").alias("rec_pos"), rec.alias("record"))


def ai_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_pos, record): model records for every part, with altered values, keys the
    golden set does not know (missing and extra records) and stale earlier duplicates.

    Each part row yields an array of record versions that is exploded in place;
    no input row is filtered out. Unknown keys are negative, so they never
    collide with real part keys at any scale."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    key_ai = F.when(key % 11 == 0, -2 * key - 2).otherwise(key)
    name = F.when(key % 5 == 0, F.upper(F.regexp_replace("p_name", " ", "_"))).otherwise(F.col("p_name"))
    brand = F.when(key % 4 == 0, F.regexp_replace("p_brand", "#", "-")).otherwise(F.col("p_brand"))
    size = F.when(key % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size"))
    words = F.when(key % 9 == 0, F.array().cast("array<string>")).otherwise(F.reverse(F.split("p_name", " ")))
    typ = F.when(key % 8 == 3, F.concat(F.col("p_type"), F.lit(" GRADE"))).otherwise(F.col("p_type"))

    def version(pos, rec):
        return F.struct(pos.alias("rec_pos"), rec.alias("record"))

    good = version(key * 4 + 1, _record(key_ai, name, brand, typ, size, words))
    stale = F.when(key % 13 == 0, version(key * 4, _record(key_ai, name, brand, F.lit("WRONG"), size, words)))
    extra = F.when(key % 17 == 0, version(key * 4 + 2, _record(-2 * key - 1, F.col("p_name"), F.col("p_brand"),
                                                                F.col("p_type"), F.col("p_size"),
                                                                F.split("p_name", " "))))
    return p.select(F.inline(F.filter(F.array(good, stale, extra), lambda v: v.isNotNull())))


# ---------------------------------------------------------------------------
# Full-text screening rows for the match cascade, from `part`
# ---------------------------------------------------------------------------

def _paper_title(name: Column) -> Column:
    """Name, type and a word of the paper's own, so that there are as many titles as papers."""
    return F.concat_ws(" ", name, "p_type", F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 14))


def golden_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden (all relevant) papers, one per part: title = name + type + a word, DOI from the key."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("paper_id"), _paper_title(F.col("p_name")).alias("title"),
                    F.concat(F.lit("10."), F.col("p_partkey").cast("string"), F.lit("/x")).alias("doi"))


def ai_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows: every part, titled so that id / exact / fuzzy / no match all occur."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    m = key % 4
    title = (F.when(m == 0, F.concat(F.lit("  "), F.upper(_paper_title(F.col("p_name"))), F.lit(" ")))
             .when(m == 1, _paper_title(F.substring("p_name", 2, 1 << 20)))
             .when(m == 2, F.concat(F.lit("10_"), key.cast("string"), F.lit("_x")))
             .otherwise(F.concat(F.lit("unrelated "), key.cast("string"))))
    return p.select(key.alias("ai_id"), title.alias("title"), (F.col("p_size") % 2).alias("relevance"))


# ---------------------------------------------------------------------------
# Markdown documents and JSON answers
# ---------------------------------------------------------------------------

def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): ``## role`` + turn text, lines in turn order, one document per conversation."""
    c = table(spark, sf_dir, "conversations")
    item = F.struct("turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text")).alias("md"))
    return c.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["md"]), "\n").alias("text"))


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, output_text): fenced, bare, array-wrapped or invalid JSON answers."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    m = F.col("event_id") % 4
    text = (F.when(F.col("event_id") % 40 == 5, F.lit("[]")).when(F.col("event_id") % 40 == 9, F.lit("{}")).when(F.col("event_id") % 40 == 13, F.lit("7"))
            .when(m == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
            .when(m == 1, F.col("props"))
            .when(m == 2, F.concat(F.lit("["), F.col("props"), F.lit(', {"k": '),
                                   (F.col("event_id") % 7).cast("string"), F.lit("}]")))
            .otherwise(F.concat(F.lit("oops "), F.col("props"))))
    return e.select("event_id", text.alias("output_text"))


def demo_scorer(row_id, prompt: str) -> dict:
    """Deterministic offline stand-in for a model call (used by tests and the bench)."""
    n = len(prompt)
    m = int(row_id) % 50
    if m == 7:
        raise RuntimeError("Error code: 429 - rate_limit_exceeded")
    if m == 13:
        raise RuntimeError("Request timeout while reading response")
    if m == 29:
        raise ValueError("invalid request: context too long")
    k = (int(row_id) * 37 + n) % 100
    return {"output_text": f"0.{k:02d}", "input_tokens": n // 4 + 1, "output_tokens": 3,
            "total_tokens": n // 4 + 4}


def papers_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents laid out as papers, so that every section rule meets its cases.

    By id, the text gets a section that is dropped, one that ends the document, a
    header in bold, or none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("doc_id") % 5
    text = (F.when(m == 0, F.concat(F.lit("# Methods\n"), F.col("text"), F.lit("\n## Funding\nsomebody paid\n\n# Results\nfound")))
            .when(m == 1, F.concat(F.col("text"), F.lit("\n# References\nfirst\n# Results\nlost")))
            .when(m == 2, F.concat(F.lit("**Acknowledgements**\nthanks\nfor all\n"), F.col("text"), F.lit("\nDiscussion\nend")))
            .when(m == 3, F.concat(F.lit("Supplementary\nmore\n#### \nrest\n"), F.col("text")))
            .otherwise(F.col("text")))
    return d.select("doc_id", text.alias("text"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): each document as a Markdown file; by id the ending is in capitals, the text Latin-1 where it can be, or the file empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    m = F.col("doc_id") % 7
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(m == 2, ".MD").otherwise(".md"))
    western = F.col("text").rlike(r"^[\x00-\x7F\x{A0}-\x{FF}]*$")
    content = (F.when((m == 3) & western, F.encode("text", "ISO-8859-1")).when(m == 5, F.lit("").cast("binary")).otherwise(F.encode("text", "UTF-8")))
    return d.select(name.alias("name"), content.alias("content"))


def long_texts(spark: SparkSession, sf_dir: str, beyond: int) -> DataFrame:
    """(doc_id, text): every tenth text repeated until it is longer than ``beyond``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.expr(f"repeat(text, cast({beyond} div greatest(length(text), 1) as int) + 1)")).otherwise(F.col("text")).alias("text"))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as people enter them: a 2, a half and gaps among 0 and 1."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("t"))
    m = F.col("doc_id") % 8
    return lab.select("doc_id", F.when(m == 1, F.lit(2.0)).when(m == 2, F.lit(0.5)).when(m == 3, F.lit(None)).otherwise(F.col("q")).alias("y_true"),
                      F.when(m == 5, F.lit(-1.0)).otherwise(F.col("t")).alias("y_pred"))


def recovered_scorer(row_id, prompt: str) -> dict:
    """The demo scorer when the service is back: only invalid requests still fail."""
    m = int(row_id) % 50
    return demo_scorer(row_id + 1 if m in (7, 13) else row_id, prompt)
