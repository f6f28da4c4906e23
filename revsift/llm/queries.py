"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsift.llm.common import prepare, table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.pii import digest_columns, find_personal_data

    prepare(spark)
    return digest_columns(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.secrets import digest_columns, find_secrets

    prepare(spark)
    return digest_columns(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def op3_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.decontam import find_passages

    prepare(spark)
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.near_dup import Params, near_duplicates

    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), Params(shingle=2))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from revsift.llm.token_counts import count_tokens
    from revsift.session import scratch_path

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a cache of its own for each run, so that a run never rests on another's work
    return count_tokens(docs, scratch_path(spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.repeats import repeated_passages

    prepare(spark)
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", told("spans"), told("later_spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.toxicity import held_out, score, train

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.mixing import mixture

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixture(docs).select("doc_id", "source", "lang", "topic", "tokens", "probability", "weight", "sampled")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.quality import judge_quality

    prepare(spark)
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.unit_dedup import remove_repeated_units

    prepare(spark)
    found = remove_repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_units", "n_removed", spans.alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.turns import damage, repair_conversations

    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_conversations(damage(rows), rows)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.near_vectors import near_vectors

    prepare(spark)
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revsift.llm.runs import digest_columns, periodic_runs, repeat_tails

    prepare(spark)
    return digest_columns(periodic_runs(repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {f.__name__: f for f in (op1_personal_data, op2_secrets, op3_benchmark_passages, op4_near_duplicates, op5_token_counts, op6_repeated_passages, op7_toxicity, op8_mixture, op9_quality, op10_repeated_lines,
                                    op11_conversation_repair, op12_near_vectors, op13_periodic_runs)}
