import math
import random
import unicodedata

from pyspark.sql import functions as F

from revsift.functions.text import clean_list, clean_value, fold_ascii, normalize_doi, normalize_title, parse_binary, \
    parse_probability, split_lines, strip_fences, token_sort

# (text, X1 probability, X2 label) — expected values of the answer parsers.
PARSE_CASES = [
    ("0.85", 0.85, 0), ("Confidence: 0.42", 0.42, 0), (" 0.7\n", 0.7, 0), ("1", 1.0, 1), ("0", 0.0, 0),
    ("1.0", 1.0, 1), ("1.00", 1.0, 1), ("10", 0.0, None), ("100%", 0.0, None), (".85", None, None),
    (".05", 0.0, None), ("1.5", 1.0, 1), ("0,85", 0.0, 0), ("-0.5", 0.5, 0), ("x0.9", 0.0, None),
    ("é0.9", 0.0, None), ("00.85", 0.0, None), ("about 2 of 10: 0.9", 0.0, 0), ("2", None, None),
    ("", None, None), ("0.", 0.0, 0), ("11", 1.0, None), ("21", 1.0, None), ("1 of 2", 1.0, 1),
    ("Score: 1", 1.0, 1), ("0.5/1.0", 0.5, 0), ("A1", 1.0, None), ("1st", None, None), ("N/A", None, None),
]


def test_parse_probability_and_binary(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PARSE_CASES)], "i int, t string")
    got = {r.i: (r.p, r.b) for r in df.select("i", parse_probability("t").alias("p"),
                                              parse_binary("t").alias("b")).collect()}
    for i, (t, p, b) in enumerate(PARSE_CASES):
        assert got[i] == (p, b), (t, got[i], (p, b))


CLEAN_CASES = [
    ("Conceição et al., 2023", "conceicao et al., 2023"), ("built_env", "built env"),
    ("  North  America ", "north america"), ("_abc", " abc"), ("a - b", "a b"),
    ("72.50 (69.5–75.3)", "72.50 (69.575.3)"), ("straße", "strae"), ("ﬁne²", "fine2"),
    ("a b", "a b"), ("32", "32"),
]


def test_clean_value(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN_CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_value("t").alias("c")).collect()}
    for i, (t, want) in enumerate(CLEAN_CASES):
        assert got[i] == want, (t, got[i], want)


def test_clean_list_sorted_and_none(spark):
    df = spark.createDataFrame([(["b_x", "A", None],)], "a array<string>")
    assert df.select(clean_list("a").alias("c")).first().c == ["a", "b x", "none"]


def test_normalizers(spark):
    df = spark.createDataFrame([("10.3390/IJERPH16091661 ", "  Walk To Work "), (None, None)],
                               "d string, t string")
    rows = df.select(normalize_doi("d").alias("d"), normalize_title("t").alias("t")).collect()
    assert rows[0].d == "10_3390_ijerph16091661" and rows[0].t == "walk to work"
    assert rows[1].d is None and rows[1].t == ""


def test_token_sort(spark):
    df = spark.createDataFrame([(" b  a\tc ",), ("",)], "t string")
    assert [r.s for r in df.select(token_sort("t").alias("s")).collect()] == ["a b c", ""]


def test_split_lines_like_python(spark):
    texts = ["a\nb", "a\n", "a\n\n", "", "\n", "a\r\nb\rc\x0bd\x1ce f", "x\x85y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.l for r in df.select("i", split_lines("t").alias("l")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == t.splitlines(), (repr(t), got[i])


def test_strip_fences(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("  [1] ",)], "t string")
    assert [r.c for r in df.select(strip_fences("t").alias("c")).collect()] == ['{"a": 1}', "[1]"]


def test_probability_nan_free():
    assert not any(isinstance(p, float) and math.isnan(p) for _, p, _ in PARSE_CASES)


def test_folding_equals_nfkd_over_all_of_unicode(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a".join(map(chr, points[i : i + 64])) for i in range(0, len(points), 64)]
    rng = random.Random(3)
    folding = [c for c in map(chr, points[127:0x2FFFF]) if unicodedata.normalize("NFKD", c).encode("ascii", "ignore")]
    texts += ["".join(rng.choices(folding + ["x", "́", "漢", "😀"] * 200, k=12)) for _ in range(2000)] + ["", None, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fold_ascii("t").alias("c"), F.transform(F.array("t"), fold_ascii)[0].alias("d"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        wanted = None if texts[r.i] is None else unicodedata.normalize("NFKD", texts[r.i]).encode("ascii", "ignore").decode()
        assert r.c == r.d == wanted, r.i
