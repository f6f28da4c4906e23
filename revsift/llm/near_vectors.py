"""Near-duplicate vectors by a pivot-permutation index (operator 12).

A few reference vectors, the pivots, are picked far apart from a bounded sample.
Each vector is described by its nearest pivots in order, and stands in inverted
lists, one for each pivot. Vectors of one label that have ``shared`` of their
``nearest`` pivots in common are candidates, and candidates are verified by their
cosine in double precision. As in any count filter, two sets of K pivots with t
in common also meet among the K - t + 1 rarest of each, so only those lists are
written, and a pair belongs to the list of its rarest common pivot.

The lists hold descriptions, not vectors. They are cut into blocks of bounded
size, a task sees two blocks of one list at a time, counts shared pivots, and
names the vectors that have a candidate there. Only their vectors are fetched
and compared, again by two blocks, and what leaves a task is for each vector its
number of links and the smallest vector that it is connected with there: no pair
is ever written. Equal vectors are one class and are compared once.

The index may miss a pair: one at a cosine of 0.98 between random directions in
64 dimensions shares less than 5 of 12 pivots out of 256 in less than 1 case of
10,000. The work in a list is quadratic in its distinct vectors, in memory.

Defined cases: a row without id, label or vector, or whose vector is empty, zero
or holds a null or non-finite component, links with nothing; its component is
its own id. Vectors of unequal lengths are not linked. Rows with the same id are
one node of the graph of components; each row has its own number of links, and
rows with a vector that also stands in other rows count those as links. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import written
from revsift.llm.components import connected

LIST = ["space", "pivot", "lo", "hi"]  # two blocks (or one, lo = hi) of the list of one pivot


@dataclass(frozen=True)
class Params:
    cosine: float = 0.98
    nearest: int = 12  # pivots that describe a vector
    shared: int = 5  # how many of them a candidate has in common
    rows_per_pivot: int = 256
    pivots: tuple[int, int] = (128, 4096)  # at least, at most
    sample: int = 8192  # about so many vectors are looked at for pivots
    block: int = 1024


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(vectors: list, size: int) -> np.ndarray:
    """Unit vectors as rows, cut or filled up with zeros to ``size`` components."""
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors, strict=True):
        v = np.asarray(v, float)[:size]
        row[: len(v)] = v
    out /= np.maximum(np.abs(out).max(axis=1, initial=0), 1e-300)[:, None]
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-300)[:, None]


def pick_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the unit vectors, each the one least like all picked before; equal ones are not picked twice."""
    picked, nearest = [0], vectors @ vectors[0]
    while len(picked) < min(count, len(vectors)):
        k = int(nearest.argmin())
        if nearest[k] > 1 - 1e-9:
            break
        picked.append(k)
        np.maximum(nearest, vectors @ vectors[k], out=nearest)
    return vectors[picked]


def describe(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """(node, space, near): the numbers of the nearest pivots, nearest first."""

    def near(batches):
        for batch in batches:
            like = directions(list(batch["vector"]), pivots.shape[1]) @ pivots.T
            order = np.argsort(-like, axis=1, kind="stable")[:, :nearest]
            yield pd.DataFrame({"node": batch["node"], "space": batch["space"], "near": list(order.astype(np.int32))})

    return classes.select("node", "space", "vector").mapInPandas(near, "node bigint, space string, near array<int>")


def in_common(mine: np.ndarray, theirs: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Which rows of two description tables share enough pivots and have ``pivot`` as the rarest common one."""
    marks, places = np.unique(np.concatenate([mine.ravel(), theirs.ravel()]), return_inverse=True)
    rows = [np.zeros((len(x), len(marks)), np.float32) for x in (mine, theirs)]
    places = np.split(places.ravel(), [mine.size])
    for table, x, at in zip(rows, (mine, theirs), places, strict=True):
        table[np.repeat(np.arange(len(x)), x.shape[1]), at] = 1
    rarer = 1000.0  # more than any count: a common pivot that is rarer rules the pair out here
    rows[1][:, marks < pivot] *= rarer
    count = rows[0] @ rows[1].T
    return (count >= shared) & (count < rarer)


def candidates(shared: int):
    """For two blocks of a list: the members that have a candidate there."""

    def of_group(group: pd.DataFrame) -> pd.DataFrame:
        sides, met = _met(group, shared)
        keep = np.zeros(len(group), bool)
        keep[sides[0][met.any(axis=1)]] = True
        keep[sides[1][met.any(axis=0)]] = True
        return group.loc[keep, [*LIST, "block", "node", "marks"]]

    return of_group


def _met(group: pd.DataFrame, shared: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Positions of the two sides in the group, and which pairs of them are candidates (each pair once)."""
    own = group["lo"].iloc[0] == group["hi"].iloc[0]
    marks, pivot, block = np.stack(group["marks"].to_numpy()), int(group["pivot"].iloc[0]), group["block"].to_numpy()
    sides = [np.arange(len(group))] * 2 if own else [np.flatnonzero(block == group[c].iloc[0]) for c in ("lo", "hi")]
    met = in_common(marks[sides[0]], marks[sides[1]], pivot, shared)
    return sides, np.triu(met, 1) if own else met


def verified(shared: int, cosine: float):
    """For two blocks of a list: the links of each member, and the smallest member that links connect it with."""

    def of_group(group: pd.DataFrame) -> pd.DataFrame:
        sides, met = _met(group, shared)
        vectors = np.stack(group["vector"].to_numpy()).astype(float)
        vectors /= np.abs(vectors).max(axis=1)[:, None]
        length = np.sqrt((vectors * vectors).sum(axis=1))
        node, n, links = group["node"].to_numpy(), group["n"].to_numpy(), np.zeros(len(group), np.int64)
        a, b = sides
        for k in range(0, len(a), 128):
            part = a[k : k + 128]
            met[k : k + 128] &= (vectors[part] @ vectors[b].T) / (length[part][:, None] * length[b]) >= cosine
            links[part] += met[k : k + 128] @ n[b]
            links[b] += n[part] @ met[k : k + 128]
        root, before = node.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            for k in range(0, len(a), 128):
                part, linked = a[k : k + 128], met[k : k + 128]
                least = np.where(linked, root[b], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
                root[part] = np.minimum(root[part], least)
                least = np.where(linked, root[part][:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
                root[b] = np.minimum(root[b], least)
        found = links > 0
        return pd.DataFrame({"node": node[found], "links": links[found], "root": root[found]})

    return of_group


def _links(classes: DataFrame, p: Params) -> DataFrame:
    """(node, links, root) of every list that holds linked vectors."""
    spark = classes.sparkSession
    rows = classes.count()
    share = min(1.0, p.sample / max(rows, 1))
    drawn = classes.where(F.pmod("d2", F.lit(1 << 30)) < int(share * (1 << 30))).select("d1", "dim", "vector").toPandas().sort_values("d1")
    if drawn.empty:
        return spark.createDataFrame([], "node bigint, links bigint, root bigint")
    size = int(drawn["dim"].mode()[0])
    pivots = pick_pivots(directions(list(drawn["vector"]), size), min(max(rows // p.rows_per_pivot, p.pivots[0]), p.pivots[1]))
    nearest = min(p.nearest, len(pivots))
    shared = max(1, nearest * p.shared // p.nearest)
    near = written(describe(classes, pivots, nearest), "pivot-permutations")

    # pivots numbered from the rarest on (at most as many rows as pivots come to the driver)
    often = {r["pivot"]: r["n"] for r in near.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = {k: i for i, k in enumerate(sorted(range(len(pivots)), key=lambda k: (often.get(k, 0), k)))}
    numbers = F.lit([place[k] for k in range(len(pivots))])
    marked = near.select("node", "space", F.sort_array(F.transform("near", lambda x: F.get(numbers, x))).alias("marks"))
    members = marked.select("node", "space", "marks", F.explode(F.slice("marks", 1, nearest - shared + 1)).alias("pivot"))
    lists = written(members.groupBy("space", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select("space", "pivot", F.ceil(F.col("n") / p.block).cast("int").alias("blocks")), "pivot-lists")
    dealt = (members.join(lists, ["space", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("space", "pivot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "marks"))
    schema = "space string, pivot int, lo int, hi int, block int, node bigint, marks array<int>"
    met = written(dealt.groupBy(*LIST).applyInPandas(candidates(shared), schema), "pivot-candidates")
    fetched = met.join(classes.select("node", "n", "vector"), "node")
    return fetched.groupBy(*LIST).applyInPandas(verified(shared, p.cosine), "node bigint, links bigint, root bigint")


def near_vectors(rows: DataFrame, p: Params | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (the smallest id reachable) and kept for each row."""
    p = p or Params()
    vector = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector)
    space = F.when(fit, F.concat_ws(":", F.size(vector).cast("string"), F.col(label_col).cast("string")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), space.alias("space"), F.size(vector).alias("dim"), F.xxhash64(vector).alias("d1"),
                       F.xxhash64(F.lit(7), vector).alias("d2"), vector.alias("vector"))
    key = ["space", "d1", "d2"]
    classes = written(rows.where("space IS NOT NULL").groupBy(*key).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
                      .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = written(_links(classes, p), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # ids that stand with several vectors connect those
    placed = rows.select("vec_id", *key).where("space IS NOT NULL").join(classes.select(*key, "node"), key)
    several = written(placed.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u < v").select("vec_id", "u"), "repeated-ids")
    edges = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not several.isEmpty():
        edges = edges.unionByName(placed.join(several, "vec_id").select("u", F.col("node").alias("v")))
    parts = connected(edges, "vector-components")
    whole = written(classes.select(*key, "node", "least", "n").join(links, "node", "left").join(parts, "node", "left")
                    .withColumn("component", F.coalesce("component", "node")), "vector-nodes")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    known = written(whole.join(least, "component").select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vector-results")
    out = rows.select("vec_id", *key).join(known, key, "left")
    return (out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", "kept"))
