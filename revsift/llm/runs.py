"""Periodic runs of words, by suffix trees and Lyndon roots (operator 13).

A run is a stretch of words that repeats with smallest period q, is at least
``max(6, 4 q)`` words long and that no neighbouring word continues. Ukkonen's
algorithm builds the suffix tree of the words and of their reversal. An Euler
tour of a tree leaves, between leaves that follow each other, the string depth
of their lowest common ancestor, and a table of range minima over it answers how
far two suffixes agree in constant time. The longest Lyndon word at each place,
under both orders of the alphabet, is the only candidate for a run's root there;
each is extended in both directions by two such answers.

Trees are built where a run can be, not over all words. In a run every three
words come again q words on, and there are at least 3 q - 2 (for q = 1: three)
such places in a row. Stretches of places whose next equal three words are near
enough for the length of the stretch hold all runs whole; this compares
fingerprints of three words, so that it may keep too much, never too little.
Memory grows with the longest such stretch of one text, some 0.6 KB a word.

Defined cases: a null or empty text has no words and no runs. Repeated rows, null
ids and texts of any length are worked on like others; other columns, whatever
their names, pass through, but for ``runs`` and ``collapsed``, which are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import let, whole_text, words_of

LEAST, TIMES = 6, 4  # fixed values: least words and periods of a run
NEVER = np.iinfo(np.int64).max
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def regions(words: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint (start, end) that hold every run whole. ``words``: 64-bit fingerprints."""
    n = len(words)
    if n < LEAST:
        return []
    w = words.view(np.uint64)
    three = w[:-2] * MIX[0] + w[1:-1] * MIX[1] + w[2:] * MIX[2]
    order = np.argsort(three, kind="stable")
    same = np.flatnonzero(three[order[1:]] == three[order[:-1]])
    gap = np.full(n - 2, NEVER)
    gap[order[same]] = order[same + 1] - order[same]
    near = gap < NEVER
    for _ in range(32):  # any number of rounds keeps all runs; more of them leave less around
        starts, ends = stretches(near)
        long = ends - starts >= 3
        starts, ends = starts[long], ends[long]
        longest = np.zeros(n - 2, np.int64)  # the longest period that fits the stretch
        sizes = ends - starts
        inside = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        longest[inside] = np.repeat((sizes + 2) // 3, sizes)
        kept = near & (gap <= longest)
        if (kept == near).all():
            break
        near = kept
    out: list[tuple[int, int]] = []
    for a, b in zip(*(x.tolist() for x in stretches(near)), strict=True):
        if b - a < 3:
            continue
        end = min(n, b + (b - a + 2) // 3 + 2)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((a, end))
    return out


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers of 0 and more."""

    def __init__(self, symbols: list[int]):
        s = self.symbols = [*symbols, -1]
        n = len(s)
        start, stop, link, kids = [0], [0], [0], [{}]

        def leaf(at: int) -> int:
            start.append(at)
            stop.append(n)
            link.append(0)
            kids.append(None)
            return len(start) - 1

        node = edge = length = left = 0
        for i, c in enumerate(s):
            left, open_node = left + 1, 0
            while left:
                if not length:
                    edge = i
                first = s[edge]
                child = kids[node].get(first)
                if child is None:
                    kids[node][first] = leaf(i)
                    if open_node:
                        link[open_node] = node
                    open_node = 0
                else:
                    begin = start[child]
                    span = min(stop[child], i + 1) - begin
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    at = begin + length
                    if s[at] == c:
                        length += 1
                        if open_node:
                            link[open_node] = node
                        break
                    start.append(begin)
                    stop.append(at)
                    link.append(0)
                    inner = len(start) - 1
                    kids.append({s[at]: child})
                    start[child], kids[node][first] = at, inner
                    kids[inner][c] = leaf(i)
                    if open_node:
                        link[open_node] = inner
                    open_node = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - left + 1
        self.start, self.stop, self.kids = start, stop, kids

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in the order of their suffixes, and the depth of the common ancestor of each with the one before.

        ``falling``: under the reversed order of the symbols. The end comes first in both."""
        start, stop, kids, n = self.start, self.stop, self.kids, len(self.symbols)
        leaves, depths, stack = [], [], [(0, 0, 0)]
        while stack:
            node, depth, common = stack.pop()
            depth += stop[node] - start[node]
            below = kids[node]
            if below is None:
                leaves.append(n - depth)
                depths.append(common)
                continue
            if falling:
                order = sorted(below)  # pushed last, visited first: the end, then the greatest
                order = [*order[1:], -1] if order[0] == -1 else order
            else:
                order = sorted(below, reverse=True)
            for symbol in order[:-1]:
                stack.append((below[symbol], depth, depth))
            stack.append((below[order[-1]], depth, common))
        return np.array(leaves), np.array(depths, np.int32)


class Agreement:
    """How many symbols two suffixes have in common, from a tour, in constant time each."""

    def __init__(self, leaves: np.ndarray, depths: np.ndarray):
        self.place = np.empty(len(leaves), np.int64)
        self.place[leaves] = np.arange(len(leaves))
        self.least = [depths]
        while (1 << len(self.least)) <= len(depths):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For suffixes i and j, not equal."""
        a, b = self.place[i], self.place[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out


def next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one of smaller rank, or the length: there the longest Lyndon word ends."""
    out, waiting = [len(ranks)] * len(ranks), []
    for i, r in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > r:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def runs_of(symbols: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of numbers, sorted by start, then period."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    tours = [tree.tour(), tree.tour(falling=True)]
    forward, backward = Agreement(*tours[0]), Agreement(*SuffixTree(symbols[::-1]).tour())
    found: set[tuple[int, int, int]] = set()
    for leaves, _ in tours:
        ranks = np.empty(n + 1, np.int64)
        ranks[leaves] = np.arange(n + 1)
        i, j = np.arange(n), np.array(next_smaller(ranks[:n].tolist()))
        period = j - i
        # the end of all words is suffix n, and agrees with none
        end, start = j + forward(i, j), i.copy()
        inner = i > 0
        start[inner] -= backward(n - i[inner], n - j[inner])
        good = end - start >= np.maximum(LEAST, TIMES * period)
        found.update(zip(start[good].tolist(), (end - start)[good].tolist(), period[good].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_in(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, sorted by start, then period."""
    out = []
    for a, b in regions(np.fromiter(map(hash, words), np.int64, len(words))):
        number: dict[bytes, int] = {}
        out += [(a + start, length, period) for start, length, period in runs_of([number.setdefault(w, len(number)) for w in words[a:b]])]
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The damage that the query works on: with h = crc32(id) and g = h / 10, where h % 10 = 0 the words from a = g % n on
    repeat the first p = 1 + (n - a) / (3 + g % 8) of them. Other rows stay as they are, as do those without id."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i).cast("int"))), " ")).otherwise("")

    return docs.withColumn(text_col, F.when(h % 10 == 0, let(words_of(whole_text(text_col)), tail)).otherwise(F.col(text_col)))


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without their text, with ``runs`` (array of start, length, period) and ``collapsed``, the text without repeats."""
    rest = [c for c in docs.columns if c not in (text_col, "runs", "collapsed")]
    docs = docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, places, kept = [], [0], []
            for text in batch.column(text_col).cast(pa.binary()).to_pylist():
                words = text.split()  # bytes: the six ASCII spaces
                runs = runs_in(words)
                found += runs
                places.append(len(found))
                kept.append(b" ".join(without_repeats(words, runs)))
            columns = [pa.array([r[k] for r in found], pa.int64()) for k in range(3)]
            spans = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(RUN)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], spans, pa.array(kept, pa.binary()).cast(pa.string())], [*rest, "runs", "collapsed"])

    schema = docs.select(*rest, F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), F.lit("").alias("collapsed")).schema
    return docs.mapInArrow(find, schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """The columns of the query, from what ``periodic_runs`` gives."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
                        F.floor(best["length"] * 1000 / -best["period"]).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
