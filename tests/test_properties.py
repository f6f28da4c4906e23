"""Row order must not matter when keys are given (explicit orders replace implicit ones)."""

import json
import random

from revsift.operators import extraction as X
from revsift.operators.records import flatten_records, parse_json_response
from revsift.plans import review


def test_key_pairing_ignores_row_order(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(200)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    results = []
    for data in (rows, shuffled):
        golden = spark.createDataFrame([(k, t) for k, t, _ in data], "k int, relevance int").repartition(3)
        ai = spark.createDataFrame([(k, p) for k, _, p in data], "k int, relevance int").repartition(5)
        m = review.evaluate_by_key(ai, golden, "k").metrics.first()
        results.append((m.tp, m.fp, m.tn, m.fn, m.recall, m.recall_ac_ci_low))
    assert results[0] == results[1]


def test_extraction_ignores_row_order_given_positions(spark):
    rnd = random.Random(9)
    objs = [{"ref": str(rnd.randint(0, 30)), "a": rnd.choice(["x", "y", ["p", "q"], None]),
             "b": rnd.choice(["1", "2"])} for _ in range(120)]

    def table(order):
        # one answer per record, answer order carried by rec_pos (the answer's index)
        rows = [(i, json.dumps([objs[i]])) for i in order]
        df = spark.createDataFrame(rows, "id int, output_text string")
        flat = flatten_records(parse_json_response(df), ["id"])
        return flat.selectExpr("id AS rec_pos", "record")

    order = list(range(120))
    rev = order[::-1]
    golden = table(order[:60])
    cells_a = X.compare_records(X.latest_records(golden, ["ref"]), X.latest_records(table(order[60:]), ["ref"]),
                                ["ref"])
    cells_b = X.compare_records(X.latest_records(table(order[:60][::-1]), ["ref"]),
                                X.latest_records(table(rev[:60]), ["ref"]), ["ref"])
    a = sorted(tuple(r) for r in cells_a.collect())
    b = sorted(tuple(r) for r in cells_b.collect())
    assert a == b and len(a) > 10
