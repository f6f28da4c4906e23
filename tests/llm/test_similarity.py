"""Near-duplicates, benchmark passages and repeated passages against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revsift.llm import components, decontam, near_dup, repeats
from revsift.llm.near_dup import Params, near_duplicates
from revsift.llm.oracle import SQL


def words(r, n, size=400):
    return [f"w{r.randint(0, size)}" for _ in range(n)]


def changed(r, ws, share):
    return [f"new{r.randint(0, 10**6)}" if r.random() < share else w for w in ws]


def sets(text, width):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def brute(texts, width):
    ids = sorted({d for d, t in texts if d is not None})
    of, link = [(d, sets(t, width)) for d, t in texts if d is not None], {d: d for d in ids}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for i, (a, x) in enumerate(of):
        for b, y in of[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                link[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, width):
    r, texts = random.Random(width), []
    for k in range(12):
        base = words(r, r.choice([3, 40, 200]))
        for j in range(r.choice([1, 2, 12])):
            texts.append((len(texts), " ".join(changed(r, base, r.choice([0, 0, 0.01, 0.03, 0.08])))))
    chain = words(r, 300)
    for j in range(10):  # each like the next, the ends unlike
        chain = chain[8:] + words(r, 8)
        texts.append((len(texts), " ".join(chain)))
    texts += [(5000, None), (5001, ""), (5002, "One"), (5003, "oNE"), (5004, "one two"), (5004, "one two"), (None, "one two")]
    r.shuffle(texts)
    rows = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), Params(shingle=width)).collect()
    want = brute(texts, width)
    assert len(rows) == len(texts)
    assert {x["doc_id"]: x["component_id"] for x in rows if x["doc_id"] is not None} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"] and x["doc_id"] is not None) for x in rows)
    assert sorted(x["n_shingles"] for x in rows) == sorted(len(sets(t, width)) for _, t in texts)


def test_rows_of_one_id_are_one_node(spark):
    r = random.Random(4)
    t, u, w, x = (" ".join(words(r, 40, 10**6)) for _ in range(4))
    texts = [(1, t), (5, t), (5, u), (2, u), (7, w), (7, x), (9, x), (6, w + " more"), (8, None), (8, w), (3, "alone")]
    rows = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), Params(shingle=2)).collect()
    assert {q["doc_id"]: q["component_id"] for q in rows if q["n_shingles"]} == {1: 1, 5: 1, 2: 1, 7: 6, 9: 6, 6: 6, 8: 6, 3: 3}
    left = near_dup.drop_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), Params(shingle=2))
    assert {q["doc_id"] for q in left.collect()} >= {1, 6, 3} and not {2, 5, 7, 9} & {q["doc_id"] for q in left.collect()}


def test_query_equals_its_sql(spark):
    import __spark_entry__ as E

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, text in SQL.items():
        df = E.queries()[name](spark, sf)
        # as plain values: pandas writes a null long as nan or <NA>, depending on where it comes from
        columns, found = sorted(df.columns), con.execute(text)
        told = [c[0] for c in found.description]
        want = [tuple(row[told.index(c)] for c in columns) for row in found.fetchall()]
        assert sorted(told) == columns
        assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want))


def test_odd_sketch_estimates_similarity():
    p, r = Params(), np.random.default_rng(1)
    signer = near_dup.Signer(p)
    for share in (0.75, 0.85, 0.95):
        errors = []
        for _ in range(20):
            both, n = r.integers(0, 2**63, 1000, np.uint64), int(1000 * (1 - share) / (2 * share + 1 - share) * 2 / 2)
            a, b = (np.unique(np.r_[both, r.integers(0, 2**63, n, np.uint64)]) for _ in range(2))
            j = 1000 / (1000 + 2 * n)
            z = np.unpackbits((signer.sketch(signer.samples(a)) ^ signer.sketch(signer.samples(b))).view(np.uint8)).sum()
            errors.append(1 + p.bits / 2 * np.log(1 - 2 * z / p.bits) / (2 * p.samples) - j)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < p.margin


def test_components_of_long_paths_and_hubs(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1400)] + [(r.randint(2000, 2200), r.randint(2000, 2200)) for _ in range(150)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(1000, 1400)} == {1000}
    assert all(got[a] == got[b] for a, b in edges if a and b and a != b)
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dropping_keeps_one_of_each_group(spark):
    t = " ".join(f"x{i}" for i in range(50))
    docs = spark.createDataFrame([(3, t, 1), (2, t + " y", 2), (2, t + " y", 2), (9, "other words here", 3), (None, t, 4), (7, None, 5)], "doc_id long, text string, kept int")
    got = near_dup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [x for k, x in enumerate(docs.collect()) if k in (1, 3, 4, 5)]))
    assert near_dup.drop_near_duplicates(docs.where("false")).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(text):
    return re.sub(r"\s+", " ", text.lower())


def test_other_scripts_and_white_space(spark):
    item = "Съешь же ещё этих мягких французских булок, да выпей чаю. Ünïcode Ärger Ωmega"
    items = spark.createDataFrame([(1, item), (2, "\u00a0\u2003"), (3, "ab")], "item_id long, text string")
    texts = [(1, "до " + item.upper() + " после"), (2, item.replace(" ", "\u00a0")), (3, "x\r\n" + item.replace(" ", "  \r\n\t") + "\n"), (4, item.replace(" ", "\u3000 ")),
             (5, item[: len(item) // 2]), (6, "\u00a0 \u00a0"), (7, "AB ab"), (8, "ab" * 30_000)]
    got = {}
    for r in decontam.find_passages(spark.createDataFrame(texts, "doc_id long, text string"), items).collect():
        got.setdefault((r["doc_id"], r["item_id"]), []).append((r["start"], r["end"], r["edits"]))
    of = dict(texts)
    assert {k: [of[k[0]][a:b] for a, b, _ in v] for k, v in got.items() if k[1] == 1} == {
        (1, 1): [item.upper()], (2, 1): [of[2]], (3, 1): [of[3][3:-1]], (4, 1): [of[4]]}
    assert all(e == 0 for v in got.values() for _, _, e in v)
    assert got[7, 3] == [(0, 2, 0), (3, 5, 0)] and got[8, 3] == [(k, k + 2, 0) for k in range(0, 60_000, 2)] and all(k[1] != 2 for k in got)


def test_passages_within_the_budget_are_found(spark):
    r = random.Random(5)
    letters = "abcdefghij klmnop"
    items = [(k, "".join(r.choice(letters) for _ in range(n)).strip() or "z") for k, n in enumerate([5, 11, 12, 40, 90, 150, 260, 400])] + [(90, None), (91, "  ")]
    p, texts = decontam.Params(piece=600), []
    for k in range(90):
        item = list(r.choice(items[:8])[1])
        for _ in range(r.randint(0, max(1, len(item) // 14))):
            j = r.randrange(len(item))
            item[j : j + 1] = r.choice([[], [r.choice(letters)], [item[j], r.choice(letters)]])
        pad = lambda: "".join(r.choice("qrstuvwxyz ") for _ in range(r.randint(0, 700)))
        texts.append((k, (pad() + "".join(item) + pad()).upper() if k % 3 == 0 else pad() + "".join(item) + pad()))
    texts += [(200, None), (201, ""), (None, items[4][1])]
    got = {}
    for x in decontam.find_passages(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), p).collect():
        got.setdefault((x["doc_id"], x["item_id"]), []).append((x["start"], x["end"], x["edits"]))
    index = decontam.Index([i for i in items if (i[1] or "").strip()], p)
    for d, t in texts:
        for n, (k, item) in enumerate(items[:8]):
            best = distance(plain(item), plain(t or ""))
            assert (best <= index.budget[n]) == ((d, k) in got), (d, k, best)
            if (d, k) in got:
                assert min(e for _, _, e in got[d, k]) == best
                assert all(distance(plain(item), plain(t[a:b])) <= e for a, b, e in got[d, k])


def test_blocks_of_the_benchmark_give_the_same(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one, many = (sorted(map(tuple, decontam.find_passages(documents, bench, decontam.Params(block_chars=b)).collect()), key=str) for b in (10**6, 2000))
    assert one == many and one
    clean = decontam.decontaminate(documents.withColumn("item_id", F.lit("mine")), bench)
    hit = {x[0] for x in one}
    assert sorted(str(x["doc_id"]) for x in clean.collect()) == sorted(str(x["doc_id"]) for x in documents.collect() if x["doc_id"] not in hit)
    assert decontam.find_passages(documents, bench.where("false")).count() == 0 == decontam.find_passages(documents.where("false"), bench).count()


def held_twice(texts, least):
    at = {}
    for d, t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        for i in range(len(ws) - least + 1):
            at.setdefault(tuple(ws[i : i + least]), set()).add(d)
    return {d for holders in at.values() if len(holders) > 1 for d in holders}, {d for holders in at.values() for d in holders if min(holders) < d}


def test_every_repeated_passage_is_found(spark):
    r, texts = random.Random(9), []
    passages = [words(r, n, 5000) for n in (49, 50, 51, 70, 130)]
    for k in range(120):
        body = words(r, r.randint(0, 150), 5000)
        for q in r.sample(passages, r.choice([0, 0, 1, 2])):
            cut = r.randint(0, len(body))
            body[cut:cut] = q
        texts.append((k, r.choice([" ", "\n", "  "]).join(body)))
    texts += [(500, " ".join(["same"] * 300)), (501, " ".join(["same"] * 200)), (502, "é " + " ".join(passages[3]))]
    docs = spark.createDataFrame([*texts, (None, texts[3][1]), (600, None), (601, "")], "doc_id long, text string")
    rows = {x["doc_id"]: x for x in repeats.repeated_passages(docs).collect()}
    held, later = held_twice(texts, 50)
    assert set(rows) == held and {d for d, x in rows.items() if x["later_spans"]} == later
    plain = dict(texts)
    for d, x in rows.items():
        for a, b in x["spans"]:
            assert len(plain[d][a:b].split()) >= 50 and (a == 0 or plain[d][a - 1].isspace()) and (b == len(plain[d]) or plain[d][b].isspace())
    cut = {x["doc_id"]: x["text"] for x in repeats.remove_later(docs, repeats.repeated_passages(docs)).collect()}
    for d, t in texts:  # cut where it was found, and nowhere else; what then meets may repeat anew
        spans = rows[d]["later_spans"] if d in rows else []
        ends = [0, *(x for s in spans for x in s), len(t)]
        assert cut[d] == "".join(t[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
    assert repeats.repeated_passages(docs.where("false")).count() == 0


def window_spans(texts, least):
    """All spans by brute force: the windows that another document holds, merged where they overlap."""
    at, out = {}, {}
    for d, t in texts:
        ws = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        for i in range(len(ws) - least + 1):
            at.setdefault(tuple(w for w, _, _ in ws[i : i + least]), []).append((d, ws[i][1], ws[i + least - 1][2]))
    for holders in at.values():
        if len({d for d, _, _ in holders}) > 1:
            for d, a, b in holders:
                out.setdefault(d, ([], []))[0].append((a, b))
                if d > min(x for x, _, _ in holders):
                    out[d][1].append((a, b))

    def union(found):
        done = []
        for a, b in sorted(found):
            if done and a <= done[-1][1]:
                done[-1] = (done[-1][0], max(b, done[-1][1]))
            else:
                done.append((a, b))
        return done

    return {d: tuple(map(union, x)) for d, x in out.items()}


def spans_of(spark, texts):
    rows = repeats.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    return {x["doc_id"]: ([tuple(s) for s in x["spans"]], [tuple(s) for s in x["later_spans"]]) for x in rows}


def test_passages_around_a_frequent_core_are_found(spark):
    """Many documents hold a core of 30 to 49 words; only two of them also share the words beside it."""
    r, texts, n = random.Random(11), [], 0
    for size in (30, 35, 40, 45, 49):
        core = words(r, size, 10**6)
        for _ in range(6):
            before = r.randint(0, 50 - size)
            sides = words(r, before, 10**6), words(r, 50 - size - before + r.randint(0, 3), 10**6)
            for _ in range(2):
                texts.append((n, " ".join([*words(r, 60, 10**6), *sides[0], *core, *sides[1], *words(r, 60, 10**6)])))
                n += 1
        for _ in range(25):
            texts.append((n, " ".join([*words(r, 60, 10**6), *core, *words(r, 60, 10**6)])))
            n += 1
    order = [k for k in range(n)]
    r.shuffle(order)
    texts = [(order[d], t) for d, t in texts]
    want = window_spans(texts, 50)
    assert len(want) == 60 and spans_of(spark, texts) == want


def test_passages_that_go_on_from_a_later_place_are_found(spark):
    """One document holds a line several times; only its last place goes on as the other document does."""
    r, texts = random.Random(12), []
    for k in range(24):
        line = words(r, 30 + k % 20, 10**6)
        beside = words(r, 50 - len(line), 10**6)
        whole = [*line, *beside] if k % 2 else [*beside, *line]
        many = [w for _ in range(4) for w in [*line, *words(r, 5, 10**6)]]
        texts.append((2 * k, " ".join([*words(r, 40, 10**6), *whole, *words(r, 40, 10**6)])))
        texts.append((2 * k + 1, " ".join([*words(r, 40, 10**6), *many, *words(r, 9, 10**6), *whole, *words(r, 40, 10**6)])))
    want = window_spans(texts, 50)
    assert len(want) == 48 and spans_of(spark, texts) == want


def test_repeats_in_long_texts_with_clashing_columns(spark):
    r = random.Random(21)
    long_one, shared = words(r, 60_000, 10**6), words(r, 80, 10**6)
    texts = [(1, " ".join(long_one[:40_000] + shared + long_one[40_000:])), (2, " ".join(words(r, 300, 10**6) + shared)), (2, " ".join(words(r, 100, 10**6))), (3, None), (4, ""), (None, " ".join(shared))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("spans", "later_spans", "start", "end", "uid", "k", "w", "v", "first")})
    found = {x["doc_id"]: x for x in repeats.repeated_passages(docs).collect()}
    cut = lambda d, t, c: [t[s["start"] : s["end"]] for s in found[d][c]]
    assert set(found) == {1, 2} and cut(1, texts[0][1], "spans") == cut(2, texts[1][1], "later_spans") == [" ".join(shared)] and not found[1]["later_spans"]
    left = repeats.remove_later(docs.where("doc_id = 1 OR length(text) > 1500 AND doc_id = 2"), repeats.repeated_passages(docs))
    assert left.columns == docs.columns and {x["spans"] for x in left.collect()} == {"mine"}
