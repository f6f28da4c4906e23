"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revsift.session import ensure_checkpoint_dir, scratch_path, ship_package

SPACE = r"[\x20\x09-\x0D]+"  # what separates words
ARROW_ROWS = 256  # whole texts travel in batches of so many rows, so that a batch stays small


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the workers, small Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OPEN: list[list[str]] = []  # the tables to be deleted at the end of each open scratch()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end, but for those made with ``keep``.

    For steps whose result is itself a kept table: nothing needs the others then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    It cuts lineage: what reads it does not run the plan before it again, and a
    lost executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often it is used."""
    return F.transform(F.array(value), body)[0]


def total(values: Column, kind: str = "int") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def whole_text(text_col: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")
