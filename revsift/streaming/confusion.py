"""Continuous scoring evaluation with Structured Streaming.

New answer files arrive in a folder; each micro-batch parses and thresholds the
answers and hands them to a streaming aggregate keyed by id, whose state holds the
last answer to each id. An answer that comes again replaces the earlier one, as the
last of repeated rows does in batch: every epoch writes the label that now holds for
each id it has met, and of an id that several epochs have met the last one counts.
Those labels are joined with the golden ones and counted. "Last" goes by the time of
the file, its name and the row in it, so that the counts equal those of a batch over
the same files, in whatever batches they came. Progress lives in
``checkpointLocation`` (shared storage): a restarted query goes on where it stopped
and reads no file twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_probability
from ..operators.metrics import threshold_label
from ..session import scratch_path

ANSWER_SCHEMA = "doc_id bigint, response string"
PLACE = ["at", "file", "row"]  # where an answer stands among all answers


def placed_answers(answers: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, y_pred, at, file, row): labels with the place of their answer, of a batch or a stream over Parquet files."""
    p = parse_probability(F.col("response"))
    return answers.where(F.col(key).isNotNull()).select(
        key, threshold_label(p, threshold).cast("int").alias("y_pred"), F.unix_micros("_metadata.file_modification_time").alias("at"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("bigint").alias("row"))


def last_labels(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, y_pred): the label of the last answer to each id; as a stream, of the ids that a micro-batch has met."""
    return placed.groupBy(key).agg(F.max(F.struct(*PLACE, "y_pred")).alias("last")).select(key, "last.y_pred")


def confusion_of_labels(labels: DataFrame, golden: DataFrame, key: str = "doc_id", truth: str = "quality") -> DataFrame:
    """One row: the four counts. A label that stands several times in ``golden`` counts once, the greatest."""
    truths = golden.where(F.col(truth).isNotNull()).groupBy(key).agg(F.max(truth).alias("y_true"))
    t, q = F.col("y_true"), F.col("y_pred")
    cells = {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}
    return labels.join(truths, key).agg(*[F.count_if((t == a) & (q == b)).alias(c) for c, (a, b) in cells.items()])


def run_available(labels: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available now. Each micro-batch writes its labels into a folder of
    its own (``epoch=N``); an epoch that is repeated after a failure replaces only itself."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = (labels.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _matches(spark: SparkSession, pattern: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def current_counts(spark: SparkSession, out_path: str, golden: DataFrame, key: str = "doc_id", truth: str = "quality") -> DataFrame:
    """The counts of the labels that hold after all epochs; zeros where there is none yet."""
    schema = f"{key} bigint, y_pred int, epoch bigint"
    rows = spark.read.schema(schema).option("basePath", out_path).parquet(f"{out_path}/epoch=*") if _matches(spark, f"{out_path}/epoch=*") else spark.createDataFrame([], schema)
    return confusion_of_labels(rows.groupBy(key).agg(F.max_by("y_pred", "epoch").alias("y_pred")), golden, key, truth)


def update_confusion_counts(spark: SparkSession, incoming: str, golden: DataFrame, out_path: str,
                            checkpoint: str, key: str = "doc_id", truth: str = "quality",
                            threshold: float = 0.5, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """Process the answer files that arrived in ``incoming`` since the last call.

    Call it again after new files land: the checkpoint remembers which files were
    read and the last answer to each id. Without any file the counts are zeros.
    ``bytes_per_trigger`` bounds a micro-batch."""
    if _matches(spark, incoming):
        answers = spark.readStream.schema(ANSWER_SCHEMA).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(incoming)
        run_available(last_labels(placed_answers(answers, key, threshold), key), out_path, checkpoint)
    return current_counts(spark, out_path, golden, key, truth)


def stream_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage the derived answers, one file a scan task, stream them, return the final counts."""
    from ..plans.inputs import screening_responses, table

    base = scratch_path(spark, "stream-confusion")
    incoming = f"{base}/incoming"
    screening_responses(spark, sf_dir).select("doc_id", "response").write.parquet(incoming)
    return update_confusion_counts(spark, incoming, table(spark, sf_dir, "labels"), f"{base}/counts",
                                   f"{base}/checkpoint")
