"""Writers: CSV / JSON tables, metric reports, dead letters, threshold-stamped outputs.

Every writer is a distributed ``DataFrame.write`` (one file per task); report
text is built as rows by Spark, never assembled on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import INTERVALS, POINT_METRICS, metrics_long


def _csv_ready(df: DataFrame) -> DataFrame:
    """Arrays/structs/variants rendered as JSON text (CSV holds scalars only)."""
    cols = []
    for name, typ in df.dtypes:
        if typ.startswith(("array", "struct", "map")):
            cols.append(F.to_json(F.col(name)).alias(name))
        elif typ == "variant":
            cols.append(F.col(name).cast("string").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Header CSV, quotes doubled, no index column."""
    (_csv_ready(df).write.mode(mode).option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("encoding", "UTF-8")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_semicolon_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Error and false-negative lists: semicolon-separated CSV."""
    write_csv(df, path, sep=";", mode=mode)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (one record per line)."""
    df.write.mode(mode).json(path)


def write_json_arrays(df: DataFrame, path: str, order_by: str, per_file: int = 10_000, mode: str = "overwrite") -> None:
    """JSON arrays of at most ``per_file`` records, one array to a file, in the order of an integer column.

    Records are gathered by blocks of ``per_file`` consecutive values of
    ``order_by``, which bounds what a task holds; values must be unique."""
    block = F.floor(F.col(order_by) / per_file).alias("block")
    item = F.struct(F.col(order_by).alias("at"), F.to_json(F.struct(*df.columns)).alias("text"))
    arrays = df.groupBy(block).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform("_items", lambda x: x["text"]), ",\n"), F.lit("\n]"))
    arrays.select("block", text.alias("value")).repartition("block").write.mode(mode).partitionBy("block").text(path)


def write_by_threshold(df: DataFrame, path: str, threshold_col: str = "threshold", mode: str = "overwrite") -> None:
    """Threshold-stamped outputs: one folder per threshold value (``threshold=0.5``)."""
    _csv_ready(df).write.mode(mode).partitionBy(threshold_col).option("header", True).csv(path)


def report_lines(metrics: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Metric bundle as ``name: value`` lines (4 decimals for floats, integers for counts,
    ``(low, high)`` for intervals), with an ``ord`` column for ordering."""
    long = metrics_long(metrics, group_by)
    counts = ["tp", "fp", "tn", "fn"]
    value = (F.when(F.col("metric").isin(*counts), F.format_string("%s: %d", "metric", F.col("value").cast("bigint")))
             .when(F.col("metric").isin(*POINT_METRICS), F.format_string("%s: %.4f", "metric", "value"))
             .otherwise(F.format_string("%s: (%.6f, %.6f)", "metric", "ci_low", "ci_high")))
    return long.select(*group_by, "ord", value.alias("line"))


def confusion_lines(metrics: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """The confusion table and the number of false negatives, before the lines of ``report_lines``."""
    line = lambda k, text: F.struct(F.lit(k).alias("ord"), text.alias("line"))
    rows = F.array(line(-4, F.lit("truth,predicted 0,predicted 1")), line(-3, F.format_string("0,%d,%d", "tn", "fp")),
                   line(-2, F.format_string("1,%d,%d", "fn", "tp")), line(-1, F.format_string("false negatives: %d", "fn")))
    return metrics.select(*group_by, F.inline(rows))


def extraction_lines(cells: DataFrame) -> DataFrame:
    """Errors, accuracy by field (best first) and accuracy by study as lines, with ``ord``."""
    from ..operators.extraction import field_accuracy, study_accuracy

    errors = cells.agg(F.count_if(~F.col("correct")).alias("n")).select(F.lit(1000).alias("ord"), F.format_string("errors: %d", "n").alias("line"))
    fields = field_accuracy(cells).select(F.lit(2000).alias("ord"), F.format_string("%s: %.4f", "field", "accuracy").alias("line"))
    study = study_accuracy(cells).select(F.lit(3000).alias("ord"), F.format_string("study accuracy: %.4f", "study_accuracy").alias("line"))
    return errors.unionByName(fields).unionByName(study)


def write_metric_report(metrics: DataFrame, path: str, group_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Text report, one folder per group when grouped; lines ordered by ``ord`` inside each file."""
    lines = report_lines(metrics, group_by)
    w = lines.repartition(*group_by) if group_by else lines.coalesce(1)  # one row per metric: bounded
    w = w.sortWithinPartitions(*group_by, "ord").select(*group_by, "line")
    if group_by:
        w.write.mode(mode).partitionBy(*group_by).text(path)
    else:
        w.write.mode(mode).text(path)


def write_dead_letter(scored: DataFrame, path: str, id_col: str = "row_id", mode: str = "append") -> None:
    """Failed inputs (error not NULL) appended to a dead-letter table."""
    scored.where(F.col("error").isNotNull()).select(id_col, "error").write.mode(mode).parquet(path)


def write_raw_responses(scored: DataFrame, path: str, mode: str = "append") -> None:
    """Model answers stored before any parsing, so that parsing can be redone without new calls."""
    scored.write.mode(mode).parquet(path)


def extraction_status(records: DataFrame) -> DataFrame:
    """One row: how many records were extracted and whether the run produced nothing."""
    return records.agg(F.count(F.lit(1)).alias("records")).withColumn(
        "status", F.when(F.col("records") == 0, F.lit("no records extracted")).otherwise(F.lit("ok")))


__all__ = ["write_csv", "write_semicolon_csv", "write_json", "write_json_arrays", "write_by_threshold", "report_lines", "confusion_lines",
           "extraction_lines",
           "write_metric_report", "write_dead_letter", "write_raw_responses", "extraction_status",
           "INTERVALS"]
