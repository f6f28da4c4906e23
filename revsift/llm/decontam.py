"""Benchmark passages in documents by the q-gram lemma (operator 3).

Two strings within e edits of each other share at least n - q + 1 - q*e of the
n - q + 1 q-grams of one of them, on diagonals at most e apart. So each
document's q-grams are looked up in an index of the items' q-grams; shared ones
are counted by item and diagonal band, where bands overlap by half so that one
of them holds every such group; a band that reaches the bound is verified by
banded alignment. A document never leaves its task, so nothing is shuffled and
no passage or item can be a hot key.

Items are compared in blocks of at most about ``block_chars`` characters, by
which what a task holds of the benchmark is bounded; each block reads the
documents once.

Texts are compared in lower case (by characters whose lower case is one
character) and with every run of white space, of any script, as one blank; places
are code points of the text as it is, the end exclusive. An item's edit budget is ``rate`` of its length, or what the lemma
allows if that is less. Items shorter than q must occur as they are.

Defined cases: null or blank items match nothing; a null or empty text holds
nothing; of overlapping finds of one item the one with the fewest edits stays,
of equal ones the first. Repeated rows and repeated items give repeated results; null
ids are carried through. Other columns are not read, or in ``decontaminate``
passed on. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int"
BLANK = 32


@dataclass(frozen=True)
class Params:
    q: int = 12
    rate: float = 0.05
    block_chars: int = 4_000_000
    piece: int = 32_768  # long texts are searched in overlapping pieces of so many characters


@cache
def _small() -> np.ndarray:
    """For each code point its lower case, or the blank for white space. Beyond its end there is neither."""
    low = (BLANK if x.isspace() else ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in map(chr, range(0x20000)))
    return np.fromiter(low, np.uint32, 0x20000)


def codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, runs of white space as one blank, and the place of each in the text."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    small = _small()
    c = small[c] if c.max(initial=0) < len(small) else np.where(c < len(small), small[np.minimum(c, len(small) - 1)], c)
    blank = c == BLANK
    places = np.flatnonzero(~(blank & np.r_[False, blank[:-1]]))
    return c[places], places


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = {1: c.astype(np.uint64) + np.uint64(1)}
    base, width = 0x9E3779B97F4A7C15, 1
    while width * 2 <= q:
        h = powers[width]
        powers[width * 2] = h[:-width] * np.uint64(pow(base, width, 2**64)) + h[width:]
        width *= 2
    out, done = powers[width][:n].copy(), width
    while done < q:
        while done + width > q:
            width //= 2
        out = out * np.uint64(pow(base, width, 2**64)) + powers[width][done : done + n]
        done += width
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], p: Params):
        self.p, q = p, p.q
        self.ids = [k for k, _ in items]
        self.items = [c[int(c[0] == BLANK) : len(c) - int(c[-1] == BLANK)] for c, _ in (codes(t) for _, t in items)]
        sizes = np.array([len(c) for c in self.items], np.int64)
        self.budget = np.where(sizes >= q, np.minimum((sizes * p.rate).astype(np.int64), (sizes - q) // q), 0)
        self.bound = sizes - q + 1 - q * self.budget
        self.short = [k for k, n in enumerate(sizes) if n < q]
        grams = [gram_hashes(c, q) for c in self.items]
        hashes = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.at = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)[order]
        self.keys, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.keys >> np.uint64(42)] = True
        self.overlap = int(max(sizes + 2 * self.budget + q, default=q))

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) for each find."""
        (c, places), step = codes(text), max(self.p.piece, 4 * self.overlap)
        found = set()
        for k in range(0, max(1, len(c) - self.overlap), step - self.overlap):
            piece = c[k : k + step]
            found |= {(i, k + a, k + b, e) for i, a, b, e in [*self._search(piece), *self._short(piece)]}
        best: list[tuple[int, int, int, int]] = []
        item, taken = None, []  # the places that are taken of one item, in order, none over another
        for f in sorted(found, key=lambda f: (f[0], f[3], f[1], f[2])):
            if f[0] != item:
                item, taken = f[0], []
            at = bisect_left(taken, f[1:3])
            if (at == 0 or taken[at - 1][1] <= f[1]) and (at == len(taken) or f[2] <= taken[at][0]):
                taken.insert(at, f[1:3])
                best.append((f[0], int(places[f[1]]), int(places[f[2] - 1]) + 1, f[3]))
        return sorted(best, key=lambda f: (f[1], f[2], f[0]))

    def _short(self, c: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        for k in self.short:
            item = self.items[k]
            at = np.flatnonzero(c[: max(0, len(c) - len(item) + 1)] == item[0])
            for a in at:
                if np.array_equal(c[a : a + len(item)], item):
                    yield k, int(a), int(a) + len(item), 0

    def _search(self, c: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        h = gram_hashes(c, self.p.q)
        hit = np.flatnonzero(self.filter[h >> np.uint64(42)])
        if not len(hit):
            return
        slot = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        same = self.keys[slot] == h[hit]
        hit, slot = hit[same], slot[same]
        n = self.count[slot]
        entry = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, at, diagonal = self.of[entry], self.at[entry], np.repeat(hit, n) - self.at[entry]
        # an item whose q-grams are too few on all diagonals together is out
        enough = (np.bincount(item, minlength=len(self.items)) >= self.bound)[item]
        if not enough.any():
            return
        item, at, diagonal = item[enough], at[enough], diagonal[enough]
        width = self.budget[item] + 1
        band = np.floor_divide(diagonal, width)
        # each diagonal lies in two bands of double width; a q-gram of the item counts once in a band
        rows = np.unique(np.stack([np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(at, 2)]), axis=1)
        if not rows.size:
            return
        start = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
        shared = np.diff(np.r_[start, rows.shape[1]])
        for s in start[shared >= self.bound[rows[0, start]]]:
            i = int(rows[0, s])
            if match := self._verify(i, c, int(rows[1, s]) * int(self.budget[i] + 1)):
                yield i, *match

    def _verify(self, i: int, c: np.ndarray, low: int) -> tuple[int, int, int] | None:
        """The best alignment of the item with the text on the diagonals of a band and a budget to either side."""
        item, e = self.items[i], int(self.budget[i])
        for d in range(max(0, low), low + 2 * e + 2):
            if d + len(item) <= len(c) and np.array_equal(c[d : d + len(item)], item):
                return d, d + len(item), 0
        if not e:
            return None
        lo, wide = low - e, 4 * e + 2
        last = align(item, c, lo, wide, np.zeros(wide, np.int64))
        edits = int(last.min())
        if edits > e:
            return None
        end = lo + len(item) + int(last.argmin())
        # back from the end, by the reversed strings
        back = c[:end][::-1]
        start_row = np.full(2 * e + 1, 10**6)
        start_row[e:] = np.arange(e + 1)
        last = align(item[::-1], back, -e, 2 * e + 1, start_row)
        return end - (len(item) - e + int(last.argmin())), end, edits


def align(item: np.ndarray, c: np.ndarray, lo: int, wide: int, row: np.ndarray) -> np.ndarray:
    """The last row of an edit-distance table kept to the diagonals lo to lo + wide - 1; ``row`` is its first."""
    padded = np.full(len(item) + wide, -1, np.int64)  # what lies outside the text matches nothing
    a, b = max(0, lo), min(len(c), lo + len(padded))
    if b > a:
        padded[a - lo : b - lo] = c[a:b]
    ramp, far = np.arange(wide), np.array([10**6])
    for i, x in enumerate(item):
        row = np.minimum(row + (padded[i : i + wide] != x), np.r_[row[1:], far] + 1)
        row = np.minimum.accumulate(row - ramp) + ramp
    return row


def _blocks(benchmark: DataFrame, p: Params, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"(?U)[^\s\x1C-\x1F]"))
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // p.block_chars))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in block.collect()]  # of bounded size


def find_passages(docs: DataFrame, benchmark: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row of FOUND for each place of a document that holds a benchmark item."""
    p = p or Params()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def one(items: list[tuple[int | None, str]]) -> DataFrame:
        index = docs.sparkSession.sparkContext.broadcast(Index(items, p))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = index.value
            for batch in batches:
                rows = [(d.as_py(), at.ids[i], a, b, e) for d, t in zip(batch.column(0), batch.column(1), strict=True) for i, a, b, e in at.find(t.as_py())]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [*[pa.int64()] * 4, pa.int32()], strict=True)],
                                                 ["doc_id", "item_id", "start", "end", "edits"])

        return docs.mapInArrow(search, FOUND)

    return reduce(DataFrame.unionByName, map(one, _blocks(benchmark, p, item_col, item_text_col)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Params | None = None, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    p = p or Params()
    for items in _blocks(benchmark, p, item_col, item_text_col):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, p))

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([not index.value.find(t.as_py()) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
