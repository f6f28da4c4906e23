"""Files that each hold one JSON array, read by many tasks in bounded memory.

An array need not have line ends, so the text reader splits files at ``}``: it
reads byte ranges, on any file system of Spark's. A task joins what it reads to
chunks of about a megabyte and notes what a chunk does to the reader's state,
once for a chunk that begins outside a string and once for one that begins in
it: the change of depth, whether the number of quotes is odd, and the commas at
each depth. Chunks are written. Going over the notes of a file's chunks, one
row each, gives the state at the start of each chunk, and with it every chunk is
cut into its elements on its own. Only elements that cross the border of a
chunk are put together by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

CHUNK = 1 << 20
END = b"}"
BOM = "\ufeff".encode()
BLANK = b" \t\r\n"
ESCAPE = re.compile(rb"\\.", re.S)
STEP = np.zeros(256, np.int8)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1
QUOTE, COMMA = ord('"'), ord(",")

CHUNKS = ("file string, start bigint, seq bigint, file_size bigint, n bigint, text binary, lead string, odd boolean, "
          "out_change bigint, out_depths array<bigint>, out_commas array<bigint>, in_change bigint, in_depths array<bigint>, in_commas array<bigint>")
STATES = "file string, start bigint, seq bigint, inside boolean, depth bigint, at bigint, opened boolean, single boolean, final boolean, cut boolean"


def _marks(text: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with escapes blotted out, whether each is outside strings, its step in depth, and the depth after it."""
    c = np.frombuffer(ESCAPE.sub(b"__", text), np.uint8)
    outside = (np.cumsum(c == QUOTE) + inside) % 2 == 0
    step = STEP[c] * outside
    return c, outside, step, depth + np.cumsum(step, dtype=np.int64)


def _noted(text: bytes) -> tuple:
    lead = text.lstrip(BLANK)[:1].decode("latin-1") or None
    out = [lead, ESCAPE.sub(b"", text).count(b'"') % 2 == 1]
    for inside in (False, True):
        c, outside, _, depth = _marks(text, inside, 0)
        depths, commas = np.unique(depth[(c == COMMA) & outside], return_counts=True)
        out += [int(depth[-1]), depths.tolist(), commas.tolist()]
    return tuple(out)


def _chunks(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    meta = lambda c: F.col(f"_metadata.{c}")
    pieces = spark.read.option("lineSep", END.decode()).text(path).select(
        meta("file_path").alias("file"), meta("file_block_start").alias("start"), meta("file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))
    columns = [c.split()[0] for c in CHUNKS.split(", ")]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seq, held, size = None, 0, [], 0

        def row() -> pd.DataFrame:
            text = b"".join(held)
            n = len(text)
            if key[1] == 0 and seq == 0:
                text = text.removeprefix(BOM)
            return pd.DataFrame([(key[0], key[1], seq, key[2], n, text, *_noted(text))], columns=columns)

        for batch in batches:
            for file, start, file_size, value in batch.itertuples(index=False):
                if (file, start, file_size) != key:
                    if held:
                        yield row()
                    key, seq, held, size = (file, start, file_size), 0, [], 0
                held += [value, END]
                size += len(value) + 1
                if size >= chunk:
                    yield row()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    return pieces.mapInPandas(join, CHUNKS)


def _states(notes: pd.DataFrame) -> pd.DataFrame:
    """The reader's state at the start of each chunk of one file."""
    notes = notes.sort_values(["start", "seq"])
    file, size = notes["file"].iloc[0], notes["file_size"].iloc[0]
    # every piece was given a closing brace; the file's last one may have had none. A byte order mark may be left out
    over = int(notes["n"].sum() - size)
    if over not in (0, 1, -len(BOM), 1 - len(BOM)):
        raise ValueError(f"{file}: not read as it is stored; compressed files are not read")
    lead = next((x for x in notes["lead"] if x is not None), None)
    if lead not in ("[", "{"):
        raise ValueError(f"{file}: not a JSON array of records")
    single = lead == "{"
    rows, inside, depth, at, opened = [], False, 0, 0, False
    for k, r in enumerate(notes.itertuples(index=False)):
        final = k == len(notes) - 1
        rows.append((file, r.start, r.seq, inside, depth, at, opened, single, final, final and over in (1, 1 - len(BOM))))
        change, depths, commas = (r.in_change, r.in_depths, r.in_commas) if inside else (r.out_change, r.out_depths, r.out_commas)
        if not single:
            at += sum(n for d, n in zip(depths, commas, strict=True) if depth + d == 1)
        depth, inside, opened = depth + change, inside != r.odd, opened or r.lead is not None
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")])


def _parts(r) -> Iterator[tuple[int, bytes, bool, bool]]:
    """(position, text, whole, last) of each element, or piece of one, in a chunk."""
    text = r.text[:-1] if r.cut else r.text
    ended, begin, mine = f"{r.file}: text after the JSON array", 0, False
    blank = not text.strip(BLANK)
    if not r.opened and not blank:
        begin, mine = len(text) - len(text.lstrip(BLANK)) + (not r.single), True
    elif blank and not r.opened or r.depth <= 0:
        if not blank:
            raise ValueError(ended)
        return
    c, outside, step, depth = _marks(text, r.inside, r.depth)
    close = np.flatnonzero((step == -1) & (depth == 0))[:1].tolist()
    if close:
        if text[close[0]] != ord("}" if r.single else "]"):
            raise ValueError(f"{r.file}: the JSON array ends with another bracket")
        if text[close[0] + 1 :].strip(BLANK):
            raise ValueError(ended)
    elif r.final:
        raise ValueError(f"{r.file}: the JSON array does not end")
    commas = [] if r.single else np.flatnonzero((c == COMMA) & outside & (depth == 1)).tolist()
    for at, end in enumerate(commas + close, r.at):
        last = bool(close) and end == close[0]
        yield at, text[begin : end + (last and r.single)], mine, last
        begin, mine = end + 1, True
    if not close:
        yield r.at + len(commas), text[begin:], False, False


def _decoded(file: str, at: int, text: bytes, last: bool) -> str | None:
    """The text of one record; an array without elements has none."""
    text = text.strip(BLANK)
    if at == 0 and last and not text:
        return None
    try:
        out = text.decode("utf-8")
        json.loads(out)
    except ValueError as e:
        raise ValueError(f"{file}: record {at}: {e}") from None
    return out


def read_array_elements(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, rec_pos, text) of every element of the arrays in ``path``; see ``readers.read_json_records``."""
    chunks = materialise(_chunks(spark, path, chunk), "json-chunks")
    notes = chunks.drop("text")
    states = materialise(notes.groupBy("file").applyInPandas(_states, STATES), "json-states")
    placed = chunks.select("file", "start", "seq", "text").join(states, ["file", "start", "seq"])
    out = "file string, rec_pos bigint, text string"

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = [(r.file, at, _decoded(r.file, at, text, last)) for at, text, mine, last in _parts(r) if mine]
                yield pd.DataFrame([x for x in rows if x[2] is not None], columns=["file", "rec_pos", "text"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.file, at, r.start, r.seq, text, last) for r in batch.itertuples(index=False) for at, text, mine, last in _parts(r) if not mine]
            yield pd.DataFrame(rows, columns=["file", "rec_pos", "start", "seq", "text", "last"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.file, r.rec_pos, _decoded(r.file, r.rec_pos, b"".join(r.x), r.last)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame([x for x in rows if x[2] is not None], columns=["file", "rec_pos", "text"])

    crossing = (placed.mapInPandas(pieces, "file string, rec_pos bigint, start bigint, seq bigint, text binary, last boolean")
                .groupBy("file", "rec_pos").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "text"))).alias("x"), F.max("last").alias("last"))
                .select("file", "rec_pos", F.col("x.text").alias("x"), "last").mapInPandas(joined, out))
    return placed.mapInPandas(whole, out).unionByName(crossing)
