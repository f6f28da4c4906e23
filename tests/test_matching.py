import random

import numpy as np
from pyspark.sql import functions as F

from revsift.operators import matching as M


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(cur[-1], prev[j + 1]))
        prev = cur
    return prev[-1]


def ratio_ok(a, b, t=90):
    s = len(a) + len(b)
    return s > 0 and 100 * (s - 2 * lcs_dp(a, b)) <= (100 - t) * s


def test_bit_parallel_lcs_equals_dp():
    rnd = random.Random(1)
    for _ in range(500):
        a = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 40)))
        b = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 40)))
        assert M._lcs_len(a, b) == lcs_dp(a, b)


def test_fuzzy_semi_join_equals_brute_force(spark):
    rnd = random.Random(3)
    words = ["walk", "bike", "health", "lane", "to", "work", "city", "safe", "route", "school", "a", "x"]
    base = [" ".join(sorted(rnd.sample(words, rnd.randint(1, 4)))) for _ in range(150)]

    def mutate(s):
        s = list(s)
        for _ in range(rnd.randint(0, 3)):
            op = rnd.random()
            i = rnd.randrange(len(s) + 1)
            if op < 0.4 and s:
                del s[min(i, len(s) - 1)]
            elif op < 0.8:
                s.insert(i, rnd.choice("abcdefgh"))
            elif s:
                s[min(i, len(s) - 1)] = rnd.choice("xyz")
        return "".join(s)

    left = sorted({mutate(rnd.choice(base)) for _ in range(200)} | {"a", "b"})
    right = sorted(set(base) | {"a"})
    L = spark.createDataFrame([(s,) for s in left], "s string")
    R = spark.createDataFrame([(s,) for s in right], "s string")
    for t in (60, 75, 90, 100):
        got = {r.s for r in M.fuzzy_semi_join(L, R, t).collect()}
        want = {a for a in left if any(ratio_ok(a, b, t) for b in right)}
        assert got == want, t
        assert len(want) > 20


def titles(rnd, n, template="effect of {} and {} on {} in {}: a review of trials"):
    word = lambda: "".join(rnd.choice("etaoinshrdlcumwfgypbvk") for _ in range(rnd.randint(6, 12)))
    return [" ".join(sorted(template.format(*(word() for _ in range(4))).split())) for _ in range(n)]


def nearly(rnd, s, edits):
    s = list(s)
    for _ in range(edits):
        i = rnd.randrange(len(s))
        s[i : i + 1] = rnd.choice([[], [s[i], rnd.choice("abc")]])
    return "".join(s)


def test_template_titles_have_few_candidates():
    """Titles of one template with unlike words: at 90 few pairs reach the LCS, and the marks are exact at any threshold."""
    rnd = random.Random(8)
    for n in (150, 1200):
        right = titles(rnd, n)
        left = titles(rnd, n - n // 10) + [nearly(rnd, s, rnd.randint(1, 5)) for s in right[: n // 10]]
        for t in (75, 90):
            a, b, looked = M.matched_strings(left, right, t)
            both = M.matched_strings(left, right, t, both=True)
            assert (both[0] == a).all()
            # at 75 the template alone is nearly enough, and no bound short of the LCS tells the titles apart
            assert t < 90 or max(looked, both[2]) < 0.01 * n * n
            assert (M.matched_strings(right, left, t)[0] == both[1]).all()
            if n == 150:
                for x, y, marks in ((left, right, a), (right, left, both[1])):
                    assert marks.tolist() == [any(200 * M._lcs_len(s, r) >= t * (len(s) + len(r)) for r in y) for s in x]
            else:  # some rows against all
                assert a.tolist()[::60] == [any(200 * M._lcs_len(s, r) >= t * (len(s) + len(r)) for r in right) for s in left[::60]]


def test_lcs_of_pairs_equals_dp():
    rnd = random.Random(5)
    some = ["".join(rnd.choice("abé😀 ") for _ in range(n)) for n in (1, 5, 63, 64, 65, 128, 130, 200)]
    others = ["".join(rnd.choice("abé😀 z") for _ in range(rnd.randint(1, 260))) for _ in range(20)] + some
    alphabet = np.unique(np.frombuffer("".join(some + others).encode("utf-32-le"), np.uint32))
    a, b = (M._Side(x, alphabet, np.zeros(len(alphabet), np.int64)) for x in (some, others))
    i, j = (x.ravel() for x in np.indices((len(some), len(others))))
    got = M._lcs_of_pairs(a.masks(0, len(some)), b.columns(), i, j, a.n[i], b.n[j])
    assert got.tolist() == [lcs_dp(x, y) for x in some for y in others]


def test_marks_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 40)
    rnd = random.Random(6)
    right = titles(rnd, 70) + ["", "a", "ab", "same"]
    left = [nearly(rnd, s, rnd.randint(0, 9)) for s in right[:30]] + titles(rnd, 40) + ["", "b", "ab", "abc", "same", None]
    L, R = (spark.createDataFrame([(s,) for s in x], "s string") for x in (left, right))
    ok = lambda a, b, t: a == b or ratio_ok(a, b, t)
    for t in (75, 90, 100):
        got = {(r.side, r.s) for r in M.fuzzy_matches(L, R, t).collect()}
        some = [s for s in left if s is not None]
        assert got == {(0, a) for a in some if any(ok(a, b, t) for b in right)} | {(1, b) for b in right if any(ok(a, b, t) for a in some)}, t
        assert {r.s for r in M.fuzzy_semi_join(L, R, t).collect()} == {s for side, s in got if side == 0}
    empty = L.where("false")
    assert M.fuzzy_matches(empty, R).count() == 0 == M.fuzzy_matches(L, empty).count()


def test_matched_and_unmatched_from_one_join(spark):
    golden = spark.createDataFrame([("10.1/a.b", "Walk to Work"), (None, "Bike Lanes and Health"), (None, "Cities, Cycling and Care"), ("10.9/z", "Unseen Paper")], "doi string, title string")
    ai = spark.createDataFrame([(1, "10_1_a_b", 1), (2, "walk to work ", 0), (3, "Health and Bike Lane", 1), (5, "Health and Bike Lane", 1), (4, "Something else", 1)],
                               "row_id int, title string, relevance int")
    matched, unmatched = M.match_both(ai, golden, "row_id", "title", "relevance", "title", golden_doi="doi")
    apart = M.match_cascade(ai, golden, "row_id", "title", "relevance", "title", golden_doi="doi")
    assert sorted(map(tuple, matched.collect())) == sorted(map(tuple, apart.collect()))
    want = {r.title for r in M.unmatched_golden(apart, golden, "title", "doi").collect()}
    assert {r.title for r in unmatched.collect()} == want == {"Unseen Paper", "Cities, Cycling and Care"}


def test_long_titles_stay_cheap(spark):
    long_ = " ".join(f"word{i % 50}" for i in range(6000))
    L = spark.createDataFrame([(long_,), ("short",)], "s string")
    R = spark.createDataFrame([(long_ + "x",), ("other",)], "s string")
    assert [r.s for r in M.fuzzy_semi_join(L, R, 90).collect()] == [long_]


def test_match_cascade_fixture(spark):
    golden = spark.createDataFrame([("10.1/a.b", "Walk to Work"), (None, "Bike Lanes and Health"),
                                    ("10.9/z", "Unseen Paper")], "doi string, title string")
    ai = spark.createDataFrame([(1, "10_1_a_b", 1), (2, "walk to work ", 0), (3, "Health and Bike Lane", 1),
                                (4, "Something else", 1)], "row_id int, title string, relevance int")
    m = M.match_cascade(ai, golden, "row_id", "title", "relevance", "title", golden_doi="doi")
    kinds = {r.ai_id: (r.match_kind, r.y_true) for r in m.collect()}
    assert kinds == {1: ("id", 1), 2: ("exact", 1), 3: ("fuzzy", 1), 4: ("none", 0)}
    un = M.unmatched_golden(m, golden, "title", "doi")
    c = M.cascade_counts(m, golden, un).first()
    assert (c.tp, c.fn, c.fp, c.tn, c.padding, c.unmatched_human) == (2, 1, 1, 0, 0, 1)
    assert [r.title for r in un.collect()] == ["Unseen Paper"]
    assert m.where(F.col("y_true") == 1).count() == 3


def test_near_pairs_are_those_that_share_enough_characters():
    """Short and long strings: a pair stays exactly when the sum of the least counts reaches the threshold."""
    rnd = random.Random(11)
    for width in (30, 9000):
        left = [nearly(rnd, "abcdefgh" * (width // 8), rnd.randint(0, width // 4)) for _ in range(20)] + [""]
        right = [nearly(rnd, s, rnd.randint(0, width // 8)) for s in left[:-1]] + ["", "a"]
        alphabet, place = np.unique(np.frombuffer("".join(left + right).encode("utf-32-le"), np.uint32)), np.arange(8)
        a, b = (M._Side(x, alphabet, place[: len(alphabet)]) for x in (left, right))
        i, j, shared = M._Near(a, b, 90).pairs(5, len(left))
        least = {(x, y): sum(min(left[x + 5].count(c), right[y].count(c)) for c in "abcdefgh") for x in range(len(left) - 5) for y in range(len(right))}
        enough = {(x, y): n for (x, y), n in least.items() if left[x + 5] + right[y] and 200 * n >= 90 * len(left[x + 5] + right[y])}
        assert dict(zip(zip(i.tolist(), j.tolist()), shared.tolist())) == enough and enough


def test_counts_are_compared_as_bits():
    """One word of bits for 64 levels; the pairs that stay are those of the plain counts, also where many words are needed."""
    from collections import Counter

    rnd = random.Random(12)
    for width, letters in ((30, 16), (150, 20), (700, 26)):
        chars = "abcdefghijklmnopqrstuvwxyz"[:letters]
        right = ["".join(rnd.choice(chars) for _ in range(rnd.randint(width // 2, width))) for _ in range(70)] + ["", "a" * width, "é😀"]
        left = [nearly(rnd, s, rnd.randint(0, width // 6)) for s in right[:40]] + ["", "b" * width, "z", "é"]
        alphabet, often = np.unique(np.frombuffer("".join(left + right).encode("utf-32-le"), np.uint32), return_counts=True)
        a, b = (M._Side(x, alphabet, np.arange(len(alphabet))) for x in (left, right))
        counts = [[Counter(s) for s in x] for x in (left, right)]
        for t in (60, 75, 90, 99):
            near = M._Near(a, b, t)
            levels = int(np.minimum(a.counts.max(axis=0), b.counts.max(axis=0)).sum())
            assert sum(w.nbytes for w in near.words) == 8 * max(1, -(-levels // 64)) * (len(left) + len(right))
            want = {(i, j): n for i, x in enumerate(counts[0]) for j, y in enumerate(counts[1])
                    if left[i] + right[j] and 200 * (n := (x & y).total()) >= t * (len(left[i]) + len(right[j]))}
            for words in {1, near.first, len(near.words[0])}:  # whatever is compared first
                near.first, near.kind, near.limits = words, np.uint16, {}
                i, j, shared = near.pairs(0, len(left))
                assert dict(zip(zip(i.tolist(), j.tolist()), shared.tolist())) == want and want


def coded(rnd, n, words=("small lamp metric", "hot gizmo promo", "blue ring story", "old plate union", "large bolt visit")):
    """Titles of some templates, each with a code of its own."""
    return [" ".join(sorted(f"{rnd.choice(words)} {rnd.getrandbits(56):014x}".split())) for _ in range(n)]


def test_only_strings_of_near_cells_are_compared(monkeypatch):
    rnd, compared = random.Random(21), []
    whole = M._Near._compared
    monkeypatch.setattr(M._Near, "_compared", lambda self, first, last, *some: compared.append((last - first) * len(some[0] if some else self.b.n)) or whole(self, first, last, *some))
    right = coded(rnd, 1500)
    left = [nearly(rnd, s, rnd.randint(1, 5)) for s in right[:200]] + coded(rnd, 1300)
    a, b, _ = M.matched_strings(left, right, 90, both=True)
    assert sum(compared) < len(left) * len(right) / 4
    ok = lambda x, y: 200 * M._lcs_len(x, y) >= 90 * (len(x) + len(y))
    assert a.tolist()[::10] == [any(ok(s, r) for r in right) for s in left[::10]] and 100 < a.sum() < 400
    assert b.tolist()[::10] == [any(ok(s, r) for s in left) for r in right[::10]]
    # whatever a sample has told
    for known in (([], []), (list(range(32, 127)), [97, 48]), ([ord(c) for c in "0123456789abcdef"], [ord("z"), ord("\u00e9")])):
        got = M.matched_strings(left, right, 90, True, known)
        assert (got[0] == a).all() and (got[1] == b).all()


def test_cells_and_blocks_lose_no_pair(spark, monkeypatch):
    """Strings are dealt to blocks by cells of a sample, others go to the cell that meets all; far blocks are not compared."""
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "CELLS", 9)
    monkeypatch.setattr(M, "SAMPLE", 40)
    dealings, whole = [], M._dealt
    monkeypatch.setattr(M, "_dealt", lambda *args: dealings.append(whole(*args)) or dealings[-1])
    rnd = random.Random(22)
    right = coded(rnd, 110) + ["", "a", "ab", "zz zz", "\u00e9\U0001f600 x", "same", "q" * 600, "pq" * 40]
    left = [nearly(rnd, s, rnd.randint(0, 9)) for s in right[:40]] + coded(rnd, 60) + ["", "b", "abc", "zz z", "\u00e9\U0001f600  x", "same", "q" * 590, "pq" * 38, None]
    L, R = (spark.createDataFrame([(s,) for s in x], "s string") for x in (left, right))
    ok = lambda a, b, t: a == b or ratio_ok(a, b, t)
    some = [s for s in left if s is not None]
    for t in (75, 90):
        got = {(r.side, r.s) for r in M.fuzzy_matches(L, R, t).collect()}
        assert got == {(0, a) for a in some if any(ok(a, b, t) for b in right)} | {(1, b) for b in right if any(ok(a, b, t) for a in some)}, t
    met = {(own, other) for *_, blocks in dealings[-1][0] for own, others in blocks for other in others}
    assert met == {(other, own) for *_, blocks in dealings[-1][1] for own, others in blocks for other in others}
    lefts, rights = ({x[k] for x in met} for k in (0, 1))
    assert len(lefts) > 3 and len(rights) > 3
    # most cells go to some of the blocks only
    sent = [len(others) for *_, blocks in dealings[-1][0] for _, others in blocks]
    assert sum(sent) < 0.8 * len(sent) * len(rights)
