"""Runs of words against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from revsift.llm import runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(s <= i and s + n >= i + length for s, n, _ in out):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def tail_repeated(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = tail_repeated(doc_id, WORD.findall(text or ""))
    found = all_runs(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_all_periods():
    r, some = random.Random(1), 0
    for _ in range(3000):
        few = r.choice([1, 2, 3, 9])
        w = [bytes([97 + r.randrange(few)]) for _ in range(r.randint(0, 40))]
        at, base = r.randint(0, len(w)), [bytes([97 + r.randrange(few)]) for _ in range(r.randint(1, 9))]
        w = w[:at] + [base[i % len(base)] for i in range(r.randint(0, 50))] + w[at:]
        want = all_runs(w)
        some += len(want)
        assert runs.runs_in(w) == want
        assert runs.runs_of([x[0] for x in w]) == want if w else True
    assert some > 2000


def test_agreement_is_exact():
    r = random.Random(2)
    for _ in range(100):
        s = [r.randrange(r.choice([1, 2, 5])) for _ in range(r.randint(2, 60))]
        tree = runs.SuffixTree(s)
        leaves, _ = tree.tour()
        assert leaves.tolist() == sorted(range(len(s) + 1), key=lambda i: [*s[i:], -1])
        assert tree.tour(falling=True)[0].tolist() == sorted(range(len(s) + 1), key=lambda i: [*(-x for x in s[i:]), -99])
        lce = runs.Agreement(*tree.tour())
        i, j = (np.array([r.randrange(len(s)) for _ in range(50)]) for _ in range(2))
        i, j = i[i != j], j[i != j]
        for a, b, n in zip(i, j, lce(i, j), strict=True):
            assert s[a : a + n] == s[b : b + n] and s[a : a + n + 1] != s[b : b + n + 1]


def test_regions_hold_runs_that_are_near_others():
    r = random.Random(4)
    for _ in range(200):
        w = []
        for _ in range(r.randint(1, 5)):
            base = [str(r.randrange(40)).encode() for _ in range(r.randint(1, 30))]
            w += [str(r.randrange(40)).encode() for _ in range(r.randint(0, 80))] + [base[i % len(base)] for i in range(r.randint(1, 6 * len(base)))]
        assert runs.runs_in(w) == all_runs(w)


def test_query_equals_all_periods(spark, documents):
    import __spark_entry__ as E

    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, E.queries()["op13_periodic_runs"](spark, SF).collect()))
    assert got == sorted(expected(*x) for x in rows if len(x[1] or "") < 10**5) and any(x[1] for x in got)


def test_odd_rows(spark, documents):
    found = runs.digest_columns(runs.periodic_runs(runs.repeat_tails(documents.where("doc_id IS NULL OR doc_id >= 900001").select("doc_id", "text"))))
    rows = [(x["doc_id"], x["text"]) for x in documents.collect() if x["doc_id"] is None or x["doc_id"] >= 900_001]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected(*x) for x in rows), key=str)
    clash = spark.createDataFrame([(1, "b b b b b b c", "mine", 7)], "doc_id long, text string, runs string, period long")
    row = runs.periodic_runs(clash).collect()[0]
    assert (row["doc_id"], row["period"], row["collapsed"], [tuple(x) for x in row["runs"]]) == (1, 7, "b c", [(0, 6, 1)])
    assert runs.periodic_runs(clash.where("false")).count() == 0


def test_a_long_periodic_text(spark):
    words = [f"w{i % 700}" for i in range(30_000)] + [f"x{i}" for i in range(1000)]
    row = runs.periodic_runs(spark.createDataFrame([(1, " \n".join(words))], "doc_id long, text string")).collect()[0]
    assert [tuple(x) for x in row["runs"]] == [(0, 30_000, 700)] and row["collapsed"].split() == words[:700] + words[30_000:]
