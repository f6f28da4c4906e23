"""Near-duplicates by MinHash and odd sketches (operator 4).

Each text becomes a set of word shingles. Texts with equal sets form a class,
of which one member goes on. Its MinHash samples give band keys; members of a
band's bucket are candidates. The samples are also folded into an odd sketch, a
parity bitmap, and the population count of two sketches' XOR estimates the
similarity; only pairs whose estimate comes near the threshold are checked on
their full shingle sets.

Candidates never become all pairs of a bucket. First each member is compared
with one other: of the first members of its buckets the one it meets most
often. The links found give components. Then buckets that still hold several
components are gone through in blocks of bounded size, sketches against
sketches, and only pairs from different components whose sketches come near
enough leave a task. A pair inside one component needs no check, so no link that
would join two texts is lost.

A pair at the threshold of 0.8 shares no band with probability
(1 - 0.8^rows)^bands, about 2e-6 for the default 7 rows and 56 bands, and far
less above it.

Defined cases: a text without words (or null) has an empty set and is linked
with nothing. Rows with the same id are one node, whatever their texts. A null id has a null
component and is not kept. Repeated rows each get a row; other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import scratch, written
from revsift.llm.components import connected

MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SIGNATURE = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>"


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    similarity: float = 0.8  # whole per cent
    bands: int = 56
    rows: int = 7
    bits: int = 1024
    block: int = 512
    margin: float = 0.14  # an estimate so far below the threshold still is checked: about five deviations

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * STEP
    return h ^ (h >> np.uint64(27))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; fewer words make one shingle, none an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = mixed(out * MIX + h[j : len(h) - width + 1 + j])
    return np.unique(out)


class Signer:
    """MinHash samples, band keys and odd sketch of a shingle set."""

    def __init__(self, p: Params):
        rng = np.random.default_rng(20240229)
        self.p = p
        self.a = rng.integers(0, 2**32, p.samples, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, p.samples, np.uint32)
        self.seeds = rng.integers(0, 2**63, p.bands, np.uint64)
        self.place = rng.integers(0, 2**63, p.samples, np.uint64)
        self.buffer = np.empty((256, p.samples), np.uint32)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        x, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(self.p.samples, 2**32 - 1, np.uint32)
        for k in range(0, len(x), 256):
            part = x[k : k + 256, None]
            out = self.buffer[: len(part)]
            np.bitwise_xor(part, self.b, out=out)
            np.multiply(out, self.a, out=out)
            np.minimum(least, out.min(axis=0), out=least)
        return least

    def bands(self, samples: np.ndarray) -> np.ndarray:
        rows, key = samples.reshape(self.p.bands, self.p.rows).astype(np.uint64), self.seeds
        for j in range(self.p.rows):
            key = mixed((key ^ rows[:, j]) * MIX)
        return key.view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        places = mixed((samples.astype(np.uint64) ^ self.place) * MIX) % np.uint64(self.p.bits)
        odd = np.bincount(places.astype(np.int64), minlength=self.p.bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """One row of SIGNATURE for each row of ``docs(doc_id, text)``."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(p)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text, p.shingle)
                d1, d2 = (np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed) for seed in (1, 2)], np.uint64).view(np.int64))
                if len(s):
                    m = signer.samples(s)
                    rows.append((len(s), d1, d2, signer.bands(m), signer.sketch(m)))
                else:
                    rows.append((0, d1, d2, [], []))
            out = pd.DataFrame(rows, columns=["n_shingles", "d1", "d2", "bands", "sketch"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.mapInPandas(sign, SIGNATURE)


def near_enough(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) with ``estimate``, where size and odd sketches allow the similarity.

    With n bits and z odd ones in the XOR, the two sets of k samples differ in
    about -n/2 ln(1 - 2z/n) elements, and k samples differ in 2k(1 - J)."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    z = F.expr("aggregate(zip_with(s_a, s_b, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    apart = F.lit(-p.bits / 2) * F.log(F.greatest(F.lit(1.0) - z * (2 / p.bits), F.lit(1e-6)))
    return (both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * round(100 * p.similarity))
            .withColumn("estimate", F.lit(1.0) - apart / (2 * p.samples))
            .where(F.col("estimate") >= p.similarity - p.margin).select("a", "b", "estimate"))


def confirmed(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t_{c}"))
    percent = round(100 * p.similarity)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_set = None, None
        for batch in batches:
            good = []
            for ta, tb in zip(batch["t_a"], batch["t_b"], strict=True):
                if ta != last:
                    last, last_set = ta, shingles(ta, p.shingle)
                other = shingles(tb, p.shingle)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                good.append(bool(len(other)) and 100 * common >= percent * (len(last_set) + len(other) - common))
            yield batch.loc[good, ["a", "b"]].rename(columns={"a": "u", "b": "v"})

    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").mapInPandas(check, "u bigint, v bigint")


def bucket_pairs(members: DataFrame, parts: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of a bucket from different components that sizes and sketches allow.

    A bucket's members are dealt to blocks of about ``p.block``; a task sees two
    blocks at a time and compares them in memory."""
    labelled = members.select("key", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    several = written(labelled.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
                      .select("key", F.ceil(F.col("n") / p.block).cast("int").alias("blocks")), "mixed-buckets")
    each = labelled.join(several, "key").join(nodes.select("node", "n_shingles", "sketch", "bands"), "node")
    item = F.struct("node", "part", "n_shingles", "sketch", "bands")
    blocks = written(each.groupBy("key", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).agg(F.collect_list(item).alias("x"))
                     .select("key", "blocks", "block", F.col("x.node").alias("node"), F.col("x.part").alias("part"), F.col("x.n_shingles").alias("n"),
                             F.flatten("x.sketch").alias("sketch"), F.flatten("x.bands").alias("bands")), "bucket-blocks")
    columns = ["node", "part", "n", "sketch", "bands"]
    same = blocks.select("key", *columns, *[F.lit(None).cast(blocks.schema[c].dataType).alias(f"{c}2") for c in columns])
    left = blocks.where("blocks > 1").select("key", F.col("block").alias("i"), *columns)
    right = blocks.where("blocks > 1").select("key", F.col("block").alias("j"), *[F.col(c).alias(f"{c}2") for c in columns])
    both = left.join(right, "key").where("i < j").drop("i", "j")
    apart = 2 * p.samples * (1 - p.similarity + p.margin)
    most = int(p.bits / 2 * (1 - math.exp(-2 * apart / p.bits)))
    percent, longs = round(100 * p.similarity), p.bits // 64

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            for key, node, part, n, sketch, bands, node2, part2, n2, sketch2, bands2 in batch.itertuples(index=False):
                own = node2 is None
                node2, part2, n2, sketch2, bands2 = (node, part, n, sketch, bands) if own else (node2, part2, n2, sketch2, bands2)
                s, s2 = np.asarray(sketch).reshape(-1, longs), np.asarray(sketch2).reshape(-1, longs)
                keys, keys2 = np.asarray(bands).reshape(-1, p.bands), np.asarray(bands2).reshape(-1, p.bands)
                for k in range(0, len(node), 64):
                    z = np.bitwise_count(s[k : k + 64, None] ^ s2[None]).sum(axis=2, dtype=np.int64)
                    a, b = n[k : k + 64, None], n2[None]
                    good = (z <= most) & (part[k : k + 64, None] != part2[None]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                    i, j = np.nonzero(good)
                    # a pair that meets in several buckets leaves only that of its first common band
                    common = keys[k + i] == keys2[j]
                    first = keys[k + i, common.argmax(axis=1)] == key
                    i, j = i[first], j[first]
                    pair = np.stack([node[k + i], node2[j]], axis=1)
                    found.append(np.sort(pair[pair[:, 0] < pair[:, 1]] if own else pair, axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return same.unionByName(both).mapInPandas(compare, "a bigint, b bigint").distinct()


def _same_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes that hold rows of one id."""
    placed = full.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "node")
    several = written(placed.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("most")).where("u < most").select("doc_id", "u"), "ids-of-classes")
    return placed.join(several, "doc_id").where("node <> u").select("u", F.col("node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept for each row."""
    p = p or Params()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, p), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # written, as is each aggregate that is joined back below: the join then deals both sides anew, and a hot key can be split
    classes = written(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = written(full.join(classes, ["d1", "d2"]).where("doc_id = node").dropDuplicates(["d1", "d2"])
                    .select("node", "n_shingles", "bands", "sketch"), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first"), "shared")
    members = written(keys.join(shared, "key"), "buckets")

    # each member and, of the first ones of its buckets, the one it shares most bands with
    met = members.where("node <> first").groupBy("node", "first").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy(F.col("node").alias("b")).agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("a"))
    links = written(confirmed(near_enough(best, nodes, p), docs, p).unionByName(_same_id(full, classes)), "links")
    parts = connected(links)
    # what may still join two components
    more = written(bucket_pairs(members, parts, nodes, p), "more-pairs")
    again = written(confirmed(more, docs, p), "more-links")
    if not again.isEmpty():
        parts = connected(links.unionByName(again))

    found = (signed.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
             .join(parts, "node", "left"))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return (found.withColumn("component_id", component)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
            .select("doc_id", "n_shingles", "component_id", "kept"))


def drop_near_duplicates(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of the smallest id; same columns.

    Of rows with one id the one whose text comes first stays. Rows with a null id stay."""
    with scratch(docs.sparkSession):
        found = written(near_duplicates(docs, p, id_col, text_col), "near", keep=True)
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    left = docs.join(gone, id_col, "left_anti")
    again = written(found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(id_col)), "repeated-ids")
    if again.isEmpty():
        return left.select(*docs.columns)
    first = (left.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(text_col)).alias("row")).select("row.*"))
    return left.join(again, id_col, "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
