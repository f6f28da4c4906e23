"""Personal data and secrets against plain regular expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from revsift.llm import pii, secrets
from revsift.llm.em import fit_votes

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PERSONAL = [("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
            ("card", CARD, lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))), ("phone", PHONE, lambda m: 9 <= len(digits(m[0])) <= 15)]
SECRETS = [("assign", f"(?ia:{ASSIGN})", lambda m: len(m[2]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)]


def expected(text, rules):
    found = sorted((m.start(), k, m.end()) for k, (_, pattern, good) in enumerate(rules) for m in re.finditer(pattern, text or "") if good(m))
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in found)


def noisy(alphabet, n, seed):
    r = random.Random(seed)
    return [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))) for i in range(n)]


def check(rows, texts, rules):
    got = sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows)
    want = sorted((str(d), hashlib.sha256(expected(t, rules).encode()).hexdigest()) for d, t in texts)
    assert got == want
    by = {}
    for d, t in texts:
        by.setdefault(d, set()).update(expected(t, rules).split(","))
    for r in rows:
        assert by[r["doc_id"]] - {""} <= set(r["spans"].split(","))
        assert all(r[f"n_{k}"] == sum(x.startswith(k + ":") for x in expected_of(by, r, rules)) for k, _, _ in rules)


def expected_of(by, r, rules):
    return [x for x in r["spans"].split(",") if x.split(":")[0] in {k for k, _, _ in rules}]


def test_personal_data_of_documents(documents, texts):
    check(pii.digest_columns(pii.find_personal_data(documents), ["doc_id"]).collect(), texts, PERSONAL)


def test_personal_data_of_noise(spark):
    texts = noisy(["a", "B", "@", ".", "1", "9", "+", "-", " ", "(", ")", "_", "255.1.", "4111 1111 1111 1111", "+1 (988) 555-2485", "é", "\U0001f600", "\n"], 400, 1)
    check(pii.digest_columns(pii.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")), ["doc_id"]).collect(), texts, PERSONAL)


def test_long_runs_stay_cheap(spark):
    texts = [(1, "a" * 200_000), (2, "1.2.3.4 " * 20_000), (3, "a." * 50_000 + "@"), (4, "x@" + "a." * 40_000 + "b"), (5, "1 " * 60_000)]
    check(pii.digest_columns(pii.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")), ["doc_id"]).collect(), texts, PERSONAL)


def test_redacted_texts_hold_no_personal_data(documents, texts):
    clean = pii.redact(documents.withColumn("pii", F.lit("mine")).withColumn("n_chars", F.lit(1)))
    rows = clean.collect()
    assert clean.columns == [*documents.columns, "pii", "n_chars"] and len(rows) == len(texts) and {r["pii"] for r in rows} == {"mine"}
    assert all(not expected(r["text"], PERSONAL[:1]) for r in rows)
    plain = {d: t for d, t in texts}
    assert all(r["text"] == plain[r["doc_id"]] for r in rows if not expected(plain[r["doc_id"]], PERSONAL))


def test_looser_kinds_need_the_classifier(spark, documents):
    more = spark.createDataFrame([(1, "Write to Dr. Anna Berg at anna.berg [at] example [dot] org or call 988-555-2485 today."), (2, "nothing here")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.digest_columns(pii.find_personal_data(documents.select("doc_id", "text").unionByName(more)), ["doc_id"]).where("doc_id in (1, 2)").collect()}
    assert found[2] == ""
    assert {x.split(":")[0] for x in found[1].split(",")} >= {"person", "masked_email", "local_phone"}


def test_no_rows(documents):
    none = documents.where("false")
    assert pii.find_personal_data(none).count() == 0 and secrets.find_secrets(none).count() == 0


def test_votes_recover_reliabilities(spark):
    r, rows = random.Random(2), []
    for _ in range(4000):
        y = r.random() < 0.7
        rows.append(tuple((1 if y == (r.random() < a) else -1) if r.random() < 0.9 else 0 for a in (0.95, 0.8, 0.6)))
    model = fit_votes(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"], prior=0.6, accuracy=0.75, steps=60)
    assert model.rates["a"][0] > model.rates["b"][0] > model.rates["c"][0]
    assert model.prior == pytest.approx(0.7, abs=0.1)


def test_secrets_of_documents(documents, texts):
    check(secrets.digest_columns(secrets.find_secrets(documents), ["doc_id"]).collect(), texts, SECRETS)


def test_secrets_of_noise(spark):
    texts = noisy(["token", "Secret", "passwd", "api_key", "APIKEY", "ſecret", "=", ": ", '"', "'", " ", "abc1", "AKIA", "ABCDEF1234567", "0123456789abcdef", "deadbeef", ".", "é"], 500, 3)
    check(secrets.digest_columns(secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")), ["doc_id"]).collect(), texts, SECRETS)


def test_network_tells_keys_from_words():
    r, p = random.Random(4), secrets.Params(epochs=12)
    keys = ["".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(300)]
    plain = ["-".join(r.choice(["release", "notes", "build", "2024", "version", "data"]) for _ in range(5)) for _ in range(300)]
    x = secrets.encoded(["key is "] * 600, keys + plain, [" "] * 600, p)
    y = secrets.np.r_[secrets.np.ones(300), secrets.np.zeros(300)]
    order = secrets.np.random.default_rng(1).permutation(600)
    x, y = x[order], y[order]
    net = secrets.Network(p)
    net.train(x[:300], y[:300])
    net.calibrate(x[300:450], y[300:450])
    q = net.probability(x[450:])
    assert ((q >= 0.5) == y[450:]).mean() > 0.97
    assert (q[y[450:] == 1] >= net.threshold).mean() > 0.9


def test_gradients_agree_with_differences():
    np, p = secrets.np, secrets.Params(embed=3, filters=4, value=8, context=4, after=2)
    net = secrets.Network(p)
    x = secrets.encoded(["ab", "xyz1"], ["k3y", "word"], ["", "!"], p)
    y = np.array([1.0, 0.0])

    def loss():
        s = net.forward(x)[0]
        return float(np.mean(np.log1p(np.exp(s)) - y * s))

    for name, g in net.gradients(x, y).items():
        flat = net.w[name].ravel()
        for k in np.random.default_rng(0).choice(flat.size, min(6, flat.size), replace=False):
            old = flat[k]
            net.w[name].ravel()[k] = old + 1e-6
            up = loss()
            net.w[name].ravel()[k] = old - 1e-6
            down = loss()
            net.w[name].ravel()[k] = old
            assert g.ravel()[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def some_key(r):
    return "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(32))


def test_parts_of_runs_beside_base_spans_are_candidates():
    key = some_key(random.Random(6))
    for text in (f"a/0123456789abcdef/{key} x", f"{key}/0123456789abcdef/b", f"0123456789abcdef/{key}/fedcba9876543210", f"{key}/0123456789abcdef/{key}1"):
        found = [text[a:b] for a, _, b in secrets.loose_spans(text, secrets.base_spans(text))]
        assert key in found and len(found) == text.count(key)


def test_keys_anywhere_in_a_long_value_are_found(spark):
    r = random.Random(7)
    path = lambda: "/".join(r.choice(["release", "notes", "build", "2024", "version", "data"]) for _ in range(16))
    findings = [("key is ", some_key(r), " ", 1) for _ in range(300)] + [("key is ", path()[:40], " ", 0) for _ in range(300)] + [("see ", path(), " ", 0) for _ in range(100)]
    findings += [("see ", f"{path()}/{some_key(r)}/{path()}", " there", 1) for _ in range(200)] + [("see ", f"{path()}/{path()}/2024", " there", 0) for _ in range(200)]
    texts = [(k, f"see {path()}/{some_key(r)}/{path()} there" if k % 2 else f"see {path()}/{path()}/2024 there") for k in range(60)]
    given = spark.createDataFrame(findings, "before string, value string, after string, label int")
    rows = secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), given, secrets.Params(epochs=12)).collect()
    right = [bool(x["secrets"]) == bool(x["doc_id"] % 2) for x in rows]
    assert sum(right) >= 54


def test_rules_label_keys_beyond_the_base_kinds(spark):
    key = some_key(random.Random(8))
    rows = [("b", key, "a", 3), ("b", f"data/notes/{key}/build", "a", 3), ("b", "release/notes/2024/version", "a", 3), ("b", "0123456789abcdef", "a", 2)]
    found = secrets.rule_findings(spark.createDataFrame(rows, "before string, value string, after string, kind int")).collect()
    assert {x["value"]: x["label"] for x in found} == {rows[0][1]: 1, rows[1][1]: 1, rows[2][1]: 0, rows[3][1]: 1}


def test_planted_keys_are_found_held_out(spark):
    docs, p = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), secrets.Params()
    side = lambda k: docs.where(F.crc32(F.col("text").cast("binary")) % 2 == k)
    network = secrets.fit_network(secrets.made_findings(side(0), p), p)
    rows = secrets.planted_findings(side(1), p).collect()
    found = network.best([(x["before"], x["value"], x["after"]) for x in rows]) >= network.threshold
    keys = [bool(f) for f, x in zip(found, rows, strict=True) if x["label"]]
    slugs = [bool(f) for f, x in zip(found, rows, strict=True) if not x["label"]]
    assert len(keys) > 300 and len(slugs) > 300
    assert sum(keys) >= 0.95 * len(keys) and sum(slugs) <= 0.02 * len(slugs)
    assert all(not secrets.HEX.fullmatch(x["value"]) for x in rows)


def test_a_key_in_a_text_is_reported_and_a_slug_is_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    key, slug = "ghp_" + some_key(random.Random(9)) + "a1B2", "notes-of-2024-on-the-release"
    more = spark.createDataFrame([(-1, f"he sent {key} to the others"), (-2, f"he sent {slug} to the others"), (-3, None), (-4, "")], docs.schema)
    found = {r["doc_id"]: r["secrets"] for r in secrets.find_secrets(docs.unionByName(more)).where("doc_id < 0").collect()}
    assert [(s["start"], s["end"]) for s in found[-1]] == [(8, 8 + len(key))] and found[-1][0]["p"] >= 0.5
    assert found[-2] == found[-3] == found[-4] == []


def test_without_a_class_only_base_spans_are_reported(spark):
    docs = spark.createDataFrame([(1, f"0123456789abcdef {some_key(random.Random(1))}")], "doc_id long, text string")
    none = spark.createDataFrame([("a", "b", "c", 0)], "before string, value string, after string, label int")
    assert [(s["kind"], s["p"]) for s in secrets.find_secrets(docs, none).first()["secrets"]] == [(2, None)]
