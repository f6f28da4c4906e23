"""Readers for screening inputs, golden sets, extraction records and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import skip_existing
from .json_arrays import read_array_elements


def read_table_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Header CSV with quoted fields, doubled quotes and embedded newlines."""
    r = (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
         .option("multiLine", True).option("encoding", "UTF-8"))
    if schema:
        r = r.schema(schema)
    return r.csv(path)


def read_candidates(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Title/abstract candidates: the first two columns by position, renamed, plus ``row_id``.

    ``row_id`` follows the file order, which is what the row index of a single
    CSV means: files by the numbers in their names (part-99999 before
    part-100000), then the position inside the file. A multi-line CSV file is read by one task, in
    order, so its rows need no sorting: positions come from the reader, and only
    the files' row counts are added up."""
    from ..session import materialise

    raw = read_table_csv(spark, path, sep=sep)
    cols = raw.columns
    read = materialise(raw.select(F.col(f"`{cols[0]}`").alias("title"), F.col(f"`{cols[1]}`").alias("abstract"),
                                  F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at")), "candidates")
    files = read.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    padded = F.regexp_replace(F.regexp_replace("_file", "([0-9]+)", "00000000000000000000$1"), "0*([0-9]{20})", "$1")
    before = F.sum("_n").over(Window.orderBy(padded, "_file").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    starts = materialise(files.select("_file", "_first", F.coalesce(before, F.lit(0)).alias("_before")), "candidate-files")
    return read.join(starts, "_file").select("title", "abstract", (F.col("_before") + F.col("_at") - F.col("_first")).alias("row_id"))


def read_golden_screening(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Golden screening table: Title, optional identifiers, Relevance (0/1)."""
    return read_table_csv(spark, path, sep=sep)


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects per file → (file, rec_pos, record VARIANT), order kept for last-wins.

    A file is read by as many tasks as it has splits, and decoded record by
    record (``json_arrays``); a single object counts as one record. What a task
    holds is about a chunk of a megabyte, or one record, if that is longer. A file that is
    not such an array, is cut short or goes on after it raises, as does a record
    that VARIANT refuses, and a compressed file. Files of zero bytes are passed
    over, as by all of Spark's readers."""
    return read_array_elements(spark, path).select("file", "rec_pos", F.parse_json("text").alias("record"))


TOGETHER = 16  # partitions of a folder of files that one task reads


def _in_fewer_tasks(files: DataFrame) -> DataFrame:
    """Files read by fewer tasks, at least sixteen a core: Spark counts each file as some megabytes
    more than it holds and gives a task a few dozen small files, so that starting tasks takes longer than reading."""
    planned = files.select("length").rdd.getNumPartitions()
    wanted = max(16 * files.sparkSession.sparkContext.defaultParallelism, planned // TOGETHER)
    return files.coalesce(wanted) if wanted < planned else files


def read_markdown_dir(spark: SparkSession, path: str) -> DataFrame:
    """``*.md`` files (any case) → (title = file stem, full_text); UTF-8, Latin-1 when not valid UTF-8.

    Files of zero bytes are passed over, as by all of Spark's readers."""
    raw = _in_fewer_tasks(spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").load(path))
    content = F.col("content")
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")) \
        .otherwise(F.decode(content, "ISO-8859-1"))
    stem = F.regexp_extract(F.col("path"), r"([^/]+)\.[mM][dD]$", 1)
    return raw.select(stem.alias("title"), text.alias("full_text"), F.col("path"))


def list_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Binary documents (path, stem, length) without reading their content, sorted by path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    stem = F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]+$", 1)
    return raw.select("path", stem.alias("stem"), "length").orderBy("path")


def pending_documents(docs: DataFrame, done: DataFrame, key: str = "stem") -> DataFrame:
    """Documents with no output yet (incremental run): anti-join on the stem."""
    return skip_existing(docs, done, key)


def golden_labels_from(df: DataFrame, title: str = "Title", relevance: str = "Relevance",
                       extra: Sequence[str] = ()) -> DataFrame:
    """Golden columns renamed to the library's lower-case names."""
    return df.select(F.col(title).alias("title"), *[F.col(c) for c in extra],
                     F.col(relevance).cast("int").alias("relevance"))
