"""End-to-end plans on small fixtures of our own."""

import json

from pyspark.sql import functions as F

from revsift.operators.records import flatten_records, parse_json_response, records_wide
from revsift.plans import review
from revsift.plans.inputs import demo_scorer
from revsift.sources import sinks


def _criteria(spark):
    return spark.createDataFrame([("r", "include", 1, "about cycling"), ("r", "exclude", 1, "simulations")],
                                 "review_id string, kind string, pos int, text string")


def test_title_abstract_plan_and_key_evaluation(spark, tmp_dir):
    cand = spark.createDataFrame([(i, f"Title {i}", None if i == 3 else f"Abstract {i}", "r") for i in range(40)],
                                 "row_id bigint, title string, abstract string, review_id string")
    scored = review.screen_title_abstract(cand, _criteria(spark), demo_scorer, raw_path=f"{tmp_dir}/raw")
    rows = {r.row_id: r for r in scored.collect()}
    assert len(rows) == 40
    assert rows[7].error is not None and rows[7].relevance == 0 and rows[7].probability is None
    ok = rows[8]
    assert ok.probability == float(ok.output_text) and ok.relevance == int(ok.probability >= 0.5)
    golden = spark.createDataFrame([(i, i % 2) for i in range(40)], "row_id bigint, relevance int")
    rep = review.evaluate_by_key(scored, golden, "row_id")
    m = rep.metrics.first()
    assert m.tp + m.fp + m.tn + m.fn == 40
    assert rep.false_negatives.count() == m.fn


def test_position_evaluation_checks_lengths(spark):
    ai = spark.createDataFrame([(i, i % 2) for i in range(10)], "k int, relevance int")
    golden = spark.createDataFrame([(i, 1) for i in range(9)], "k int, relevance int")
    try:
        review.evaluate_by_position(ai, golden, ["k"], ["k"])
        raise AssertionError("length mismatch not detected")
    except ValueError:
        pass
    rep = review.evaluate_by_position(ai, golden.unionByName(spark.createDataFrame([(9, 0)], "k int, relevance int")),
                                      ["k"], ["k"])
    m = rep.metrics.first()
    assert (m.tp, m.fp, m.tn, m.fn) == (4, 1, 0, 5)


def test_full_text_plan_cleans_before_prompting(spark):
    docs = spark.createDataFrame([(1, "a", "intro\n# Funding\nsecret\n# Methods\nm", "r")],
                                 "row_id bigint, title string, full_text string, review_id string")
    seen = []

    def scorer(rid, prompt):
        seen.append(prompt)
        return {"output_text": "0.9", "input_tokens": 1, "output_tokens": 1, "total_tokens": 2}

    out = review.screen_full_text(docs, _criteria(spark), scorer).first()
    assert out.relevance == 1


def test_cascade_evaluation(spark):
    golden = spark.createDataFrame([("Walk to Work",), ("Bike Lanes and Health",), ("Unseen Paper",)], "title string")
    ai = spark.createDataFrame([(1, "walk to work", 1), (2, "Health and Bike Lane", 0), (3, "Other", 1)],
                               "row_id int, title string, relevance int")
    rep = review.evaluate_with_cascade(ai, golden)
    m = rep.metrics.first()
    assert (m.tp, m.fn, m.fp, m.tn) == (1, 1 + 1, 1, 0)
    assert [r.ai_id for r in rep.false_negatives.collect()] == [2]


def test_extraction_evaluation_and_wide_table(spark, tmp_dir):
    def recs(objs):
        df = spark.createDataFrame([(1, "```json\n" + json.dumps(objs) + "\n```")], "id int, output_text string")
        return flatten_records(parse_json_response(df), ["id"]).select("rec_pos", "record")

    golden = recs([{"tool": "A", "type": "CNN", "phases": ["screening"]}, {"tool": "B", "type": "SVM", "phases": []}])
    ai = recs([{"tool": "a", "type": "cnn", "phases": ["Screening"]}, {"tool": "B", "type": "svm"},
               {"tool": "C", "type": "x"}])
    rep = review.evaluate_extraction(golden, ai, ["tool"])
    m = rep.metrics.first()
    assert (m.tp, m.fn) == (3, 2)  # b.phases: [] vs missing; c.type
    assert rep.coverage.first().coverage == 1.0
    assert rep.study_accuracy.first().study_accuracy == 1 / 3
    wide = records_wide(ai, [("phases", "variant"), ("tool", "string"), ("type", "string")])
    assert wide.columns == ["phases", "tool", "type"] and wide.count() == 3
    sinks.write_semicolon_csv(rep.errors, f"{tmp_dir}/errors")
    assert spark.read.option("header", True).option("sep", ";").csv(f"{tmp_dir}/errors").count() == 2
    assert sinks.extraction_status(ai).first().status == "ok"
    assert sinks.extraction_status(ai.where(F.lit(False))).first().status == "no records extracted"


def test_key_field_can_still_be_scored(spark):
    """Composite key, one key part still compared as a field, another field ignored."""
    def recs(objs):
        df = spark.createDataFrame([(1, json.dumps(objs))], "id int, output_text string")
        return flatten_records(parse_json_response(df), ["id"]).select("rec_pos", "record")

    golden = recs([{"n": 1, "crit": "a", "ref": "x", "v": "1"}, {"n": 2, "crit": "b", "ref": "y", "v": "2"}])
    ai = recs([{"n": 1, "crit": "A", "ref": "other", "v": "1"}])
    rep = review.evaluate_extraction(golden, ai, ["n", "crit"], skip_fields=["crit", "ref"])
    cells = {(r.record, r.field): r.correct for r in rep.cells.collect()}
    assert cells == {("1||a", "n"): True, ("1||a", "v"): True, ("2||b", "n"): False, ("2||b", "v"): False}


def test_false_negatives_keep_golden_columns(spark):
    golden = spark.createDataFrame([(1, "Paper A", 1), (2, "Paper B", 1), (3, "Paper C", 0)],
                                   "row_id int, title string, relevance int")
    ai = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "row_id int, relevance int")
    fn = review.evaluate_by_key(ai, golden, "row_id").false_negatives.collect()
    assert [(r.row_id, r.human_title) for r in fn] == [(2, "Paper B")]
