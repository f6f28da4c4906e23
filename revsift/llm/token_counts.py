"""Token counts with a digest cache (operator 5).

A cache table holds (content digest, tokenizer digest, n_tokens). Documents are
joined to it by the digest of their normalised content; of what is missing each
distinct text is encoded once, and its count is appended to the cache. The
documents then take their counts from the cache.

Normalising must not change a count, so it only makes a null text empty. The
tokenizer digest covers the vocabulary file and the library's version.

Defined cases: a null or empty text has 0 bytes and 0 tokens; each row gets a
row, repeated ones too; other columns pass through, but for those named like
the results, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsift.llm.common import whole_text

CACHE = "content string, tokenizer string, n_tokens bigint"


def load_counter(name: str, blob: bytes):
    """A function from text to its number of tokens: SentencePiece for .model, tokenizers for .json."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(blob)
    model.no_truncation()
    model.no_padding()
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def tokenizer_digest(name: str, blob: bytes) -> str:
    library = "sentencepiece" if name.endswith(".model") else "tokenizers"
    return hashlib.sha256(blob + f"\n{library} {version(library)}".encode()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; an absent one counts as empty. An entry that was appended twice appears once."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` without the text column, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Texts that no cache entry covers are encoded here, at once, and appended."""
    spark = docs.sparkSession
    name, blob = Path(tokenizer_path).name, Path(tokenizer_path).read_bytes()
    mark = tokenizer_digest(name, blob)
    shipped = spark.sparkContext.broadcast(blob)  # one vocabulary file

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = load_counter(name, shipped.value)
        for batch in batches:
            yield pd.DataFrame({"content": batch["content"], "tokenizer": mark, "n_tokens": [count(x) for x in batch["body"]]})

    cache = read_cache(spark, cache_path)
    known = cache.where(F.col("tokenizer") == mark).select("content", "n_tokens")
    keyed = docs.select(F.sha2(whole_text(text_col), 256).alias("content"), whole_text(text_col).alias("body"))
    # partial aggregation leaves one text per task and digest before anything is shuffled
    distinct = keyed.groupBy("content").agg(F.any_value("body").alias("body"))
    distinct.join(known, "content", "left_anti").mapInPandas(encode, CACHE).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == mark).select(F.col("content").alias("_content"), "n_tokens")
    rest = [c for c in docs.columns if c not in {text_col, "n_bytes", "n_tokens", "over_limit", "_content"}]
    lean = docs.select(*rest, F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"), F.sha2(whole_text(text_col), 256).alias("_content"))
    return (lean.join(counts, "_content", "left").drop("_content")
            .withColumn("over_limit", F.col("n_tokens") > limit)
            .select(*rest, "n_bytes", "n_tokens", "over_limit"))


