"""Batch scoring with a user-supplied function, and the bookkeeping around it.

``score_rows`` runs the scorer inside ``mapInArrow``: Spark partitions the rows
(``partitions`` limits the number of concurrent callers; without it the input's own partitions stay),
each task feeds Arrow batches to the Python worker, and a failing row yields a
NULL answer, zero tokens and the error text instead of failing the job. However many
rows a batch of the session holds, the worker makes Python strings of ``SCORED_ROWS`` prompts
at a time; kept columns stay as they are in Arrow.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import error_class
from .. import defaults as D
from ..session import materialise, scratch_path
from .ordering import row_index, running_sum

SCORED_FIELDS = [("output_text", "string"), ("input_tokens", "bigint"), ("output_tokens", "bigint"),
                 ("total_tokens", "bigint"), ("error", "string")]

SCORED_ROWS = 256  # rows whose prompts and answers a worker holds as Python values

# A scorer takes (row id, prompt) and returns
# {"output_text": str, "input_tokens": int, "output_tokens": int, "total_tokens": int};
# it raises on failure.
Scorer = Callable[[object, str], dict]


def score_rows(df: DataFrame, scorer: Scorer, id_col: str = "row_id", prompt: str = "prompt",
               partitions: int | None = None, keep: Sequence[str] = (),
               shard_col: str | None = None) -> DataFrame:
    """One output row per input row: id, kept columns, answer text, token counts, error.

    With ``shard_col`` (see ``assign_shards``), rows are hash-partitioned by
    shard into ``partitions`` tasks and the scorer is called as
    ``scorer(row_id, prompt, shard)``, so each task serves its own keys."""
    id_type = dict(df.dtypes)[id_col]
    if shard_col and shard_col not in keep:
        keep = [*keep, shard_col]
    keep_types = [(c, dict(df.dtypes)[c]) for c in keep]
    schema = ", ".join([f"{id_col} {id_type}"] + [f"`{c}` {t}" for c, t in keep_types]
                       + [f"{n} {t}" for n, t in SCORED_FIELDS])
    src = df.select(id_col, *keep, prompt)
    if shard_col:
        src = src.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism, shard_col)
    elif partitions:
        src = src.repartition(partitions)

    def scored(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, ins, outs, tots, errs = [], [], [], [], []
        ids, prompts = (part.column(c).to_pandas() for c in (id_col, prompt))
        shards = part.column(shard_col).to_pandas() if shard_col else [None] * len(part)
        for rid, p, sh in zip(ids, prompts, shards):
            try:
                r = scorer(rid, p, sh) if shard_col else scorer(rid, p)
                answer = (r.get("output_text"), *(int(r.get(c, 0) or 0) for c in ("input_tokens", "output_tokens", "total_tokens")), None)
            except Exception as e:  # row-level isolation: the job goes on
                answer = (None, 0, 0, 0, str(e))
            for column, value in zip((texts, ins, outs, tots, errs), answer, strict=True):
                column.append(value)
        told = [pa.array(x, t) for x, t in zip((texts, ins, outs, tots, errs), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in (id_col, *keep)), *told], [id_col, *keep, *(n for n, _ in SCORED_FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SCORED_ROWS):
                yield scored(batch.slice(first, SCORED_ROWS))

    return src.mapInArrow(run, schema)


def with_error_class(scored: DataFrame, error: str = "error") -> DataFrame:
    return scored.withColumn("error_class", error_class(F.col(error)))


def retry_failed(scored: DataFrame, inputs: DataFrame, scorer: Scorer, id_col: str = "row_id",
                 prompt: str = "prompt", retryable: Sequence[str] = D.RETRYABLE_CLASSES, rounds: int = 1) -> DataFrame:
    """Re-submit rows whose error class is retryable, up to ``rounds`` times; keep every other row as it was.

    ``scored`` and each round's answers are written before anything reads them,
    so the scorer is called once for every row of ``scored`` and once for each
    retried row, and an answer that succeeded is never asked for again."""
    current = materialise(scored, "scored")
    for _ in range(rounds):
        again = with_error_class(current).where(F.col("error_class").isin(*retryable)).select(id_col)
        rescored = materialise(score_rows(inputs.join(again, id_col, "left_semi"), scorer, id_col, prompt,
                                          keep=[c for c in scored.columns if c not in {id_col, *dict(SCORED_FIELDS)}]), "rescored")
        current = current.join(again, id_col, "left_anti").unionByName(rescored)
    return current


LEDGER = "block string, attempt int, rows bigint, failed bigint, finished timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a table that may be absent or hold no file yet; its schema is known, not looked for."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _last_answers(rows: DataFrame, id_col: str) -> DataFrame:
    others = [c for c in rows.columns if c != id_col]
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*others), "attempt").alias("_r")).select(id_col, "_r.*")


def scoring_progress(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a scored table: each finished block, and how many rows were done and had failed by then."""
    done = Window.orderBy("finished", "block").rowsBetween(Window.unboundedPreceding, 0)  # one row a block
    return _stored(spark, f"{path}/ledger", LEDGER).select("*", F.sum("rows").over(done).alias("rows_done"), F.sum("failed").over(done).alias("failed_so_far"))


def score_to_table(inputs: DataFrame, scorer: Scorer, path: str, id_col: str = "row_id", prompt: str = "prompt",
                   keep: Sequence[str] = (), blocks: int | None = None, rounds: int = 0,
                   retryable: Sequence[str] = D.RETRYABLE_CLASSES, block_rows: int = 100_000,
                   on_block: Callable[[str, int, int], None] | None = None) -> DataFrame:
    """Score into the table at ``path``, which survives a failed run.

    Rows the table holds already are not scored again. The others are written once,
    cut into ``blocks`` by a hash of the id (or blocks of about ``block_rows``), and
    scored block by block. Each block's answers become a folder of the table when all its
    tasks have ended, and then a row of the ledger (``scoring_progress``); ``on_block`` is told
    its name, its rows and how many of them failed. A run that is killed loses the
    answers of the block it was in, and the next call asks only for what the table
    lacks, also where the folder is absent, empty or half written. Then rows whose
    last answer failed with a retryable class are asked again, up to ``rounds``
    times, as blocks of their own. Returns the last answer to each row."""
    spark = inputs.sparkSession
    types = dict(inputs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (id_col, *keep)), *(f"{n} {t}" for n, t in SCORED_FIELDS), "attempt int"])
    answers = lambda: _stored(spark, f"{path}/answers", schema).drop("block")
    tasks = spark.sparkContext.defaultParallelism

    def put(rows: DataFrame, name: str, attempt: int, partitions: int | None) -> None:
        part = f"{path}/answers/block={name}-{uuid.uuid4().hex[:8]}"
        score_rows(rows, scorer, id_col, prompt, partitions, keep=keep).withColumn("attempt", F.lit(attempt)).write.parquet(part)
        done = spark.read.schema(schema).parquet(part)
        n, failed = done.agg(F.count(F.lit(1)), F.count_if(F.col("error").isNotNull())).first()
        entry = spark.createDataFrame([(name, attempt, n, failed)], "block string, attempt int, rows bigint, failed bigint")
        entry.withColumn("finished", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
        if on_block:
            on_block(name, n, failed)

    todo = inputs.join(answers().select(id_col).distinct(), id_col, "left_anti").select(id_col, *keep, prompt)
    if blocks == 1:
        put(todo, "0-of-1", 0, None)
    else:
        if blocks is None:
            todo = materialise(todo, "to-score")
            blocks = max(1, -(-todo.count() // block_rows))
        where = scratch_path(spark, "score-blocks")
        todo.withColumn("_block", F.pmod(F.xxhash64(id_col), F.lit(blocks))).repartition("_block").write.partitionBy("_block").parquet(where)
        rest = todo.schema
        for k in range(blocks):
            if _exists(spark, f"{where}/_block={k}"):  # else no row of this block is left
                put(_stored(spark, f"{where}/_block={k}", rest), f"{k}-of-{blocks}", 0, tasks)
    for _ in range(rounds):
        last = with_error_class(_last_answers(answers(), id_col)).where(F.col("error_class").isin(*retryable))
        attempt = last.agg(F.max("attempt")).first()[0]
        if attempt is None:
            break
        put(inputs.join(materialise(last.select(id_col), "to-retry"), id_col, "left_semi"), f"retry-{attempt + 1}", attempt + 1, None)
    return _last_answers(answers(), id_col).drop("attempt")


def dead_letter(scored: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows that failed, with their error and its class."""
    return with_error_class(scored).where(F.col("error").isNotNull()).select(id_col, "error", "error_class")


def token_totals(scored: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    t = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")]
    g = scored.groupBy(*group_by) if group_by else scored.groupBy()
    return g.agg(*t, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def assign_shards(df: DataFrame, order_by: Sequence, k: int, name: str = "shard") -> DataFrame:
    """Round-robin key index: the i-th row (explicit order) goes to shard i % k."""
    idx = row_index(df, order_by, "_idx")
    return idx.withColumn(name, (F.col("_idx") % F.lit(k)).cast("int")).drop("_idx")


def running_tokens(scored: DataFrame, order_by: Sequence, block_size: int = 1 << 20,
                   run_col: str | None = None) -> DataFrame:
    """Cumulative token totals in row order (``completed`` = 1-based position).

    Only the ordering columns and the token counts are sorted and checkpointed.
    With ``run_col``, totals and positions restart for every run: rows are
    ordered by (run, order) globally, and each run's starting offsets (one row
    per run, written first) are subtracted through a join whose hot runs adaptive
    execution can split."""
    cols = ["input_tokens", "output_tokens", "total_tokens"]
    order = ([run_col] if run_col else []) + list(order_by)
    keys = [c for c in order if isinstance(c, str)]
    # written first: sorting by range samples its input, which would run the scorer twice
    idx = row_index(materialise(scored.select(*dict.fromkeys(keys + cols)), "tokens"), order, "_idx")
    out = running_sum(idx, "_idx", cols, ["cum_" + c for c in cols], block_size)
    if run_col:
        starts = out.groupBy(run_col).agg(
            F.min("_idx").alias("_first"),
            *[F.min(F.col("cum_" + c) - F.coalesce(F.col(c), F.lit(0))).alias("_base_" + c) for c in cols])
        out = out.join(materialise(starts, "run-starts"), run_col, "left")
        for c in cols:
            out = out.withColumn("cum_" + c, F.col("cum_" + c) - F.col("_base_" + c))
        out = out.withColumn("_idx", F.col("_idx") - F.col("_first")) \
            .drop("_first", *["_base_" + c for c in cols])
    return out.withColumn("completed", F.col("_idx") + 1).drop("_idx")


def checkpoint_rows(running: DataFrame, every: int) -> DataFrame:
    """The rows at which a progress file is written: every ``every`` completed rows."""
    return running.where(F.col("completed") % F.lit(every) == 0)
