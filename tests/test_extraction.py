import json

from pyspark.sql import functions as F

from revsift.operators import extraction as X
from revsift.operators.records import flatten_records, last_wins, parse_json_response, record_key


def records(spark, objs):
    """(rec_pos, record) from a list of JSON objects, as an extraction answer would give them."""
    df = spark.createDataFrame([(1, json.dumps(objs))], "id int, output_text string")
    return flatten_records(parse_json_response(df), ["id"]).select("rec_pos", "record")


# (human value or MISSING, ai value or MISSING, equal)
MISSING = object()
J9 = [
    (MISSING, None, True), (MISSING, "", True), ([], MISSING, False), (["a", "b"], ["b", "a"], True),
    (["a", "a"], ["a"], False), (["a"], "a", False), ([10, 9], ["9", "10"], True), (32, "32", True),
    ("built_env", "Built-Env", True),
]


def test_cell_equality_table(spark):
    human, ai = [], []
    for i, (h, a, _) in enumerate(J9):
        hrec, arec = {"ref": str(i)}, {"ref": str(i)}
        if h is not MISSING:
            hrec["f"] = h
        if a is not MISSING:
            arec["f"] = a
        human.append(hrec)
        ai.append(arec)
    cells = X.compare_records(X.latest_records(records(spark, human), ["ref"]),
                              X.latest_records(records(spark, ai), ["ref"]), ["ref"])
    got = {r.record: r.correct for r in cells.collect()}
    for i, (_, _, eq) in enumerate(J9):
        assert got[str(i)] == eq, (J9[i], got[str(i)])


def test_last_wins_and_union_of_fields(spark):
    human = [{"ref": "A", "x": "1"}, {"ref": "B", "x": "2", "y": "z"}]
    ai = [{"ref": "A", "x": "0"}, {"ref": "A", "x": "1", "w": "extra"}, {"ref": "C", "x": "3"}]
    cells = X.compare_records(X.latest_records(records(spark, human), ["ref"]),
                              X.latest_records(records(spark, ai), ["ref"]), ["ref"])
    got = {(r.record, r.field): (r.human, r.ai, r.correct) for r in cells.collect()}
    assert got == {("a", "x"): ("1", "1", True), ("a", "w"): ("", "extra", False),
                   ("b", "x"): ("2", "", False), ("b", "y"): ("z", "", False), ("c", "x"): ("", "3", False)}
    m = X.extraction_metrics(cells).first()
    assert (m.tp, m.fp, m.tn, m.fn) == (1, 0, 0, 4)
    assert X.study_accuracy(cells).first().study_accuracy == 0.0
    cov = X.coverage(records(spark, human).select(record_key(F.col("record"), ["ref"]).alias("record_id")),
                     records(spark, ai).select(record_key(F.col("record"), ["ref"]).alias("record_id"))).first()
    assert (cov.human_records, cov.ai_records, cov.union_records, cov.matched_records) == (2, 2, 3, 1)
    assert cov.coverage == 0.5


def test_composite_key_and_lenient_comparator(spark):
    human = [{"ref_num": 29, "criterion_name": "Self reported", "gold_standard": "CDC/AAP [9,10]"},
             {"ref_num": 30, "criterion_name": "x", "gold_standard": "Gomes-Filho et al. [13]"}]
    ai = [{"ref_num": 29, "criterion_name": "self reported", "gold_standard": "CDC/AAP criteria [9,10]"},
          {"ref_num": 30, "criterion_name": "x", "gold_standard": "CDC/AAP criteria (periodontitis) [9,10]"}]
    keys = ["ref_num", "criterion_name"]
    h, a = (X.latest_records(records(spark, x), keys) for x in (human, ai))
    exact = {r.record: r.correct for r in X.compare_records(h, a, keys).collect()}
    lenient = {r.record: r.correct for r in X.compare_records(h, a, keys, {"gold_standard": X.TOKEN_SUBSET}).collect()}
    assert exact == {"29||self reported": False, "30||x": False}
    assert lenient == {"29||self reported": True, "30||x": False}


def test_field_accuracy_order(spark):
    human = [{"ref": str(i), "a": "x", "b": "y"} for i in range(4)]
    ai = [{"ref": str(i), "a": "x", "b": "y" if i < 2 else "n"} for i in range(4)]
    cells = X.compare_records(X.latest_records(records(spark, human), ["ref"]),
                              X.latest_records(records(spark, ai), ["ref"]), ["ref"])
    assert [(r.field, r.accuracy) for r in X.field_accuracy(cells).collect()] == [("a", 1.0), ("b", 0.5)]
    assert [r.field for r in X.error_preview(cells, 5).collect()] == ["b", "b"]


def test_flatten_rules(spark):
    df = spark.createDataFrame([(0, '[{"k":1},{"k":2}]'), (1, '{"k":3}'), (2, "[]"), (3, "{}"), (4, "7"),
                                (5, "not json")], "id int, output_text string")
    flat = flatten_records(parse_json_response(df), ["id"])
    assert sorted((r.id, r.rec_pos) for r in flat.collect()) == [(0, 0), (0, 1), (1, 0)]


def test_last_wins_generic(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", 2, "only")], "k string, pos int, v string")
    assert sorted(tuple(r) for r in last_wins(df, "k", "pos").collect()) == [("a", 3, "new"), ("b", 2, "only")]


def test_duplicate_json_keys_keep_the_last_value(spark):
    df = spark.createDataFrame([(1, '{"ref": "a", "x": "1", "x": "2"}')], "id int, output_text string")
    rec = flatten_records(parse_json_response(df), ["id"]).first().record
    assert json.loads(rec.toJson()) == {"ref": "a", "x": "2"}


def test_json_numbers_print_like_python(spark):
    human = [{"ref": "1", "v": 86.0, "w": 72.50, "n": 5, "b": True, "z": 0.10}]
    ai = [{"ref": "1", "v": "86.0", "w": "72.5", "n": "5", "b": "true", "z": "0.1"}]
    cells = X.compare_records(X.latest_records(records(spark, human), ["ref"]),
                              X.latest_records(records(spark, ai), ["ref"]), ["ref"])
    got = {r.field: (r.human, r.correct) for r in cells.collect()}
    assert got == {"v": ("86.0", True), "w": ("72.5", True), "n": ("5", True), "b": ("true", True),
                   "z": ("0.1", True)}


# human value, model value, whether the cells agree
CELLS = [
    ("X_y", "x y", True), ("a-b", "A B", True), (" pad ", "pad", True), ("Ærø", "r", True), (None, "", True), ("", [], False),
    (["p", "Q"], ["q", "p"], True), (["p", "p"], ["p"], False), (["p", None], ["none", "p"], True), ([], [], True), (7, "7", True),
    (3, [3], False), ("two  words", "two\twords", True), ("x", "y", False), (True, "true", True), (["10", 9], [9, "10"], True),
]


def test_cells_table_and_symmetry(spark):
    human = [{"ref": f"k{i}", "f": h} for i, (h, _, _) in enumerate(CELLS)]
    ai = [{"ref": f"K{i}", "f": a} for i, (_, a, _) in enumerate(CELLS)]
    one = X.latest_records(records(spark, human), ["ref"])
    two = X.latest_records(records(spark, ai), ["ref"])
    there = {r.record: r.correct for r in X.compare_records(one, two, ["ref"]).collect()}
    back = {r.record: r.correct for r in X.compare_records(two, one, ["ref"]).collect()}
    assert there == back == {f"k{i}": same for i, (_, _, same) in enumerate(CELLS)}
    itself = X.compare_records(one, one, ["ref"])
    assert itself.where("NOT correct").count() == 0 and itself.count() == len(CELLS)
