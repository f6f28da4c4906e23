"""Passages that repeat across documents, by minimisers and exact windows (operator 6).

Every window of ``least`` words is told by one position, its minimiser: of the
first ``window`` word positions the one whose next ``gram`` words hash lowest.
The ``seed`` words from there lie in the window, so two copies of a window have
the same seed. Seeds that only one document holds rule their windows out. All
other windows are fingerprinted whole, by 96 bits of their words, and those
that two documents hold are the result: a span is the union of such windows
that overlap. Nothing rests on which documents are compared, as none are.

A seed or window that m documents hold gives m rows, never pairs. Its holders
are counted by a partial aggregation; the keys that stay are written, so that
the join back to the holders can be split where a passage is frequent.

Words are compared in lower case (A-Z). Places are code points, the end
exclusive. A span is ``later`` if it repeats a document of a smaller id.

Defined cases: null or empty texts, those under ``least`` words, and rows with a
null id have no spans and no row in the result. Rows with the same id and text
are one document; rows with one id and different texts are different
documents, told apart by a hash of the text. Only id and text are read. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import scratch, whole_text, written
from revsift.llm.decontam import gram_hashes

SEED = "k bigint, at int, doc_id bigint, uid bigint"
WINDOW = "w bigint, v int, doc_id bigint, uid bigint, start int, end int"
SPANS = "array<struct<start:int,end:int>>"
ROWS = 200_000  # windows that leave a task at once
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Params:
    least: int = 50  # words
    window: int = 20
    gram: int = 6

    @property
    def seed(self) -> int:
        return self.least - self.window


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def minimisers(h: np.ndarray, p: Params) -> np.ndarray:
    """For each window of ``least`` words the place of its seed."""
    n = len(h) - p.least + 1
    if n <= 0:
        return np.empty(0, np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(gram_hashes(h, p.gram), p.window)[:n]
    return grams.argmin(axis=1) + np.arange(n)


def seeds(docs: DataFrame, p: Params) -> DataFrame:
    """The seeds of each document: place and fingerprint."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((4, 0), np.int64)]
            for doc, uid, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "text")), strict=True):
                h = word_hashes(text)
                at = np.unique(minimisers(h, p))
                if len(at):
                    out.append(np.stack([gram_hashes(h, p.seed).view(np.int64)[at], at, np.full(len(at), doc), np.full(len(at), uid)]))
            k, at, doc, uid = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, at.astype(np.int32), doc, uid)], ["k", "at", "doc_id", "uid"])

    return docs.mapInArrow(keep, SEED)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The start and end of each word, in code points."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = np.r_[False, ~((raw == 32) | ((raw >= 9) & (raw <= 13))), False]
    first, last = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    if len(raw) == len(text):
        return first, last
    before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # code points before each byte
    return before[first], before[last]


def windows(docs: DataFrame, hits: DataFrame, p: Params) -> DataFrame:
    """The windows whose seed is among ``hits``: two fingerprints and the place in the text."""

    def of(text: str, ats: list[int]) -> list[np.ndarray]:
        h = word_hashes(text)
        s = np.flatnonzero(np.isin(minimisers(h, p), ats))
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        first, last = word_places(text)
        return [gram_hashes(h, p.least).view(np.int64)[s], (gram_hashes(mixed ^ (mixed >> np.uint64(32)), p.least)[s] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                first[s].astype(np.int32), last[s + p.least - 1].astype(np.int32)]

    def put(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        w, v, start, end, doc, uid = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (w, v, doc, uid, start, end)], ["w", "v", "doc_id", "uid", "start", "end"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, uid, text, ats in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "text", "ats")), strict=True):
                found = of(text, ats)
                held.append([*found, np.full(len(found[0]), doc, np.int64), np.full(len(found[0]), uid, np.int64)])
                n += len(found[0])
                if n >= ROWS:
                    yield put(held)
                    held, n = [], 0
        if held:
            yield put(held)

    return docs.join(hits, ["doc_id", "uid"]).select("doc_id", "uid", "text", "ats").mapInArrow(keep, WINDOW)


def held_twice(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that two documents hold, with the first of them."""
    holder = F.struct("doc_id", "uid")
    return rows.groupBy(*keys).agg(F.min(holder).alias("first"), F.max(holder).alias("last")).where("first <> last").drop("last")


def shared_seeds(kept: DataFrame) -> DataFrame:
    """The seeds that two documents hold."""
    ends = [f(c).alias(f.__name__ + c) for c in ("doc_id", "uid") for f in (F.min, F.max)]
    return kept.groupBy("k").agg(*ends).where("mindoc_id <> maxdoc_id OR minuid <> maxuid").select("k")


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``written``, and the shuffles that led to the table are freed at once: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(FREE)
    conf.set(FREE, "true")
    try:
        return written(df, name, keep)
    finally:
        conf.set(FREE, before)


def united(marks: DataFrame) -> DataFrame:
    """Per document: ``spans`` and ``later_spans``, the windows merged where they overlap, in order."""

    def union(start: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
        if not len(start):
            return []
        order = np.argsort(start)
        start, end = start[order], end[order]  # the windows of a text start and end in the same order
        new = np.flatnonzero(start[1:] > end[:-1])
        return [{"start": a, "end": b} for a, b in zip(start[np.r_[0, new + 1]].tolist(), end[np.r_[new, len(end) - 1]].tolist(), strict=True)]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for marks in batch.column("marks"):
                start, end, later = (np.asarray(marks.values.field(c).to_numpy(zero_copy_only=False)) for c in ("start", "end", "later"))
                found[0].append(union(start, end))
                found[1].append(union(start[later], end[later]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, kind) for x in found)], ["doc_id", "spans", "later_spans"])

    each = marks.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start", "end", "later")).alias("marks"))
    return each.select("doc_id", "marks").mapInArrow(merge, f"doc_id bigint, spans {SPANS}, later_spans {SPANS}")


def repeated_passages(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans and later_spans of the documents that hold a passage of at least ``least`` words of another document."""
    p = p or Params()
    docs = (docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).where("doc_id IS NOT NULL")
            .withColumn("uid", F.xxhash64("text")))
    with scratch(docs.sparkSession):
        kept = stored(seeds(docs, p), "seeds")
        shared = stored(shared_seeds(kept), "shared-seeds")
        hits = stored(kept.join(shared, "k").groupBy("doc_id", "uid").agg(F.collect_set("at").alias("ats")), "hits")
        found = stored(windows(docs, hits, p), "windows", keep=True)
    repeated = stored(held_twice(found, ["w", "v"]), "repeated-windows", keep=True)
    return united(found.join(repeated, ["w", "v"]).select("doc_id", "uid", "start", "end", (F.struct("doc_id", "uid") != F.col("first")).alias("later")))


def remove_later(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that a document of a smaller id holds.

    Meant for tables with one row for each id."""
    cut = found.where(F.size("later_spans") > 0).select(F.col("doc_id").alias(id_col), F.col("later_spans").alias("_later"))
    kept = F.expr(f"aggregate(_later, named_struct('out', '', 'at', 0), (acc, s) -> named_struct('out', concat(acc.out, substring({text_col}, acc.at + 1, s.start - acc.at)), "
                  f"'at', s.end), acc -> concat(acc.out, substring({text_col}, acc.at + 1)))")
    return docs.join(cut, id_col, "left").withColumn(text_col, F.when(F.col("_later").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
