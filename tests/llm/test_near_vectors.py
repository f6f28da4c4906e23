"""Linked vectors against all pairs."""

import numpy as np
import pytest

from revsift.llm import near_vectors as nv

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """n_links of each row and the component of each id."""
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), {i: i for i, _, _ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(good):
        for b in good[:n]:
            x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a] += 1
                links[b] += 1
                p, q = top(rows[a][0]), top(rows[b][0])
                root[max(p, q)] = min(p, q)
    return links, {i: top(i) for i in root}


def check(spark, rows, p=None):
    got = sorted(map(tuple, nv.near_vectors(spark.createDataFrame(rows, SCHEMA), p).collect()), key=str)
    links, parts = brute(rows)
    want = sorted(((i, n, parts.get(i), i is not None and parts[i] == i) for (i, _, _), n in zip(rows, links, strict=True)), key=str)
    assert got == want
    return links


def scattered(r, n, dim=24):
    """Vectors alone, pairs, chains and a dense group."""
    out = list(r.normal(size=(n, dim)))
    for k in range(0, n // 3):
        out.append(out[k] + r.normal(size=dim) * r.choice([0.02, 0.1, 0.2]))
    step = r.normal(size=dim)
    for _ in range(20):
        step = step + r.normal(size=dim) * 0.12
        out.append(step)
    centre = r.normal(size=dim)
    out += [centre + r.normal(size=dim) * 0.09 for _ in range(60)]
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, block):
    r = np.random.default_rng(block)
    rows = [(k, [float(np.float32(x)) for x in v], int(r.integers(0, 2))) for k, v in enumerate(scattered(r, 150))]
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(5)] + [(1100, [2 * x for x in rows[3][1]], rows[3][2]), (1101, rows[3][1], 1 - rows[3][2])]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [None, *rows[0][1][1:]], rows[0][2]), (2004, [float("nan"), *rows[0][1][1:]], rows[0][2]),
             (2005, [float("inf"), *rows[0][1][1:]], rows[0][2]), (2006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (2007, rows[0][1][:5], rows[0][2]), (2008, rows[0][1][:5], rows[0][2])]
    rows += [rows[5], rows[5], (7, rows[80][1], rows[80][2])]  # a repeated row, and an id that stands with two vectors
    links = check(spark, rows, nv.Params(block=block, rows_per_pivot=8, pivots=(32, 64)))
    assert sum(links) > 1000


def test_small_and_empty_tables(spark):
    assert nv.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, [1.0, 0.0], 3)])
    check(spark, [(2, [1.0, 0.0], 3), (1, [3.0, 0.1], 3), (4, [-1.0, 0.0], 3), (5, [1.0, 0.0], 4), (6, None, None)])
    extra = spark.createDataFrame([(1, [1.0], 3, 9, 9), (2, [2.0], 3, 9, 9)], SCHEMA + ", node long, n_links long")
    assert sorted(map(tuple, nv.near_vectors(extra).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_index_recall(spark):
    """Pairs at 0.98 and more in 64 dimensions, among vectors that are alone: nearly all are found, none is made up."""
    r = np.random.default_rng(5)
    base = r.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = r.normal(size=base.shape)
    other -= (other * base).sum(axis=1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    c = 0.9801 + 0.015 * r.random((3000, 1))
    vectors = np.concatenate([base, c * base + np.sqrt(1 - c * c) * other]).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(vectors)], SCHEMA)
    links = {x["vec_id"]: x["n_links"] for x in nv.near_vectors(frame).collect()}
    found = np.mean([links[k] for k in range(6000)])
    assert 0.999 <= found <= 1 and max(links.values()) == 1


def test_pivots_are_unlike_each_other():
    r = np.random.default_rng(2)
    v = nv.directions([*r.normal(size=(50, 8)), *[np.ones(8)] * 50], 8)
    picked = nv.pick_pivots(v, 40)
    assert len(picked) == 40 and (picked @ picked.T - 2 * np.eye(40)).max() < 1 - 1e-9
    assert len(nv.pick_pivots(v, 100)) == 51
