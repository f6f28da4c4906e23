import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revsift.plans.catalog import QUERIES
from revsift.sources import json_arrays, readers, sinks
from revsift.streaming.confusion import stream_confusion_counts
from revsift.operators.metrics import screening_metrics

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_with_quotes_and_newlines(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in.csv")
    with open(src, "w", encoding="utf-8") as f:
        f.write('Title,Abstract,Extra\n"A, ""quoted"" title","line one\nline two",x\nPlain,[No abstract available],y\n')
    cand = readers.read_candidates(spark, src)
    rows = {r.row_id: (r.title, r.abstract) for r in cand.collect()}
    assert rows == {0: ('A, "quoted" title', "line one\nline two"), 1: ("Plain", "[No abstract available]")}
    out = os.path.join(tmp_dir, "out")
    sinks.write_semicolon_csv(cand.withColumn("arr", F.array(F.lit("a"))), out)
    back = readers.read_table_csv(spark, out, sep=";")
    assert back.count() == 2 and set(back.columns) == {"title", "abstract", "row_id", "arr"}


def test_json_records_and_markdown(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "g.json"), "w") as f:
        json.dump([{"ref": "a", "x": 1}, {"ref": "b", "x": [1, 2]}], f, indent=2)
    recs = readers.read_json_records(spark, os.path.join(tmp_dir, "g.json"))
    assert [r.rec_pos for r in recs.orderBy("rec_pos").collect()] == [0, 1]
    md = os.path.join(tmp_dir, "md")
    os.makedirs(md)
    open(os.path.join(md, "10_1_x.md"), "w", encoding="utf-8").write("# T\nüber")
    open(os.path.join(md, "old.MD"), "wb").write("caf\xe9".encode("latin-1"))
    open(os.path.join(md, "skip.txt"), "w").write("no")
    docs = {r.title: r.full_text for r in readers.read_markdown_dir(spark, md).collect()}
    assert docs == {"10_1_x": "# T\nüber", "old": "café"}
    listed = readers.list_documents(spark, md, "*.md")
    assert [r.stem for r in listed.collect()] == ["10_1_x"]
    done = spark.createDataFrame([("10_1_x",)], "stem string")
    assert readers.pending_documents(listed, done).count() == 0


def test_json_arrays_of_any_size_and_broken_ones(spark, tmp_dir):
    big = os.path.join(tmp_dir, "big")
    os.makedirs(big)
    rec = json.dumps({"ref": "x" * 300, "a": [1, {"b": "}],["}], "n": None})
    n = 60_000
    with open(os.path.join(big, "a.json"), "w") as f:
        f.write("\ufeff [" + " ,\n".join([rec] * n) + "]\n")
    with open(os.path.join(big, "b.json"), "w") as f:
        f.write(" [ ] ")
    got = readers.read_json_records(spark, big).agg(F.count("record").alias("n"), F.max("rec_pos").alias("last")).first()
    assert (got.n, got.last) == (n, n - 1)
    for k, text in enumerate(["[" + rec + ",", "[" + rec, "[1, 2", rec + " tail", "[" + rec + "] x", " ", "7", '[{"a": }]']):
        path = os.path.join(tmp_dir, f"bad{k}.json")
        with open(path, "w") as f:
            f.write(text)
        with pytest.raises(Exception):
            readers.read_json_records(spark, path).collect()


def _random_json(rng, deep):
    words = ["}", "{", "[", "]", ",", '"', "\\", "\\\\", "é", "\u2028", "a", "\n", "}" * 40, "x" * 90, "\\}", '"}', ":"]
    kind = rng.randrange(6 if deep else 3)
    if kind < 2:
        return "".join(rng.choices(words, k=rng.randrange(6)))
    if kind == 2:
        return rng.choice([None, True, 1, -2.5, 10**12])
    if kind == 3:
        return [_random_json(rng, deep - 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choices(words, k=2)): _random_json(rng, deep - 1) for _ in range(rng.randrange(4))}


def _random_file(rng, single):
    records = {"only": _random_json(rng, 3), "r": [_random_json(rng, 2) for _ in range(20)]} if single else [_random_json(rng, 3) for _ in range(rng.randrange(60))]
    text = json.dumps(records, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
    text = rng.choice(["", " ", "\ufeff", "\ufeff\r\n"]) + text + rng.choice(["", "\n", "  "])
    return [records] if single else records, text.encode()


def _by_chunks(data, chunk):
    """What the steps of the array reader make of one file, without Spark."""
    pieces = data.split(b"}")
    pieces = pieces[:-1] if data.endswith(b"}") else pieces
    texts, held = [], b""
    for p in pieces:
        held += p + b"}"
        if len(held) >= chunk:
            texts, held = [*texts, held], b""
    texts = [*texts, held] if held else texts
    names = [c.split()[0] for c in json_arrays.CHUNKS.split(", ")]
    rows = []
    for k, t in enumerate(texts):
        body = t.removeprefix(json_arrays.BOM) if k == 0 else t
        rows.append(("f", 0, k, len(data), len(t), body, *json_arrays._noted(body)))
    chunks = pd.DataFrame(rows, columns=names)
    states = json_arrays._states(chunks.drop(columns="text")).merge(chunks[["seq", "text"]], on="seq")
    found, last_of = {}, {}
    for r in states.itertuples(index=False):
        for at, text, _, last in json_arrays._parts(r):
            found[at] = found.get(at, b"") + text
            last_of[at] = last_of.get(at, False) or last
    out = [json_arrays._decoded("f", at, found[at], last_of[at]) for at in sorted(found)]
    return [json.loads(x) for x in out if x is not None]


def test_json_arrays_by_chunks_of_any_size():
    rng = random.Random(5)
    for k in range(60):
        records, data = _random_file(rng, k % 6 == 0)
        for chunk in (1, 97, 500, 10**6):
            assert _by_chunks(data, chunk) == records
    rec = json.dumps({"a": "}", "b": [{}, {}]})
    for text in [f"[{rec},", f"[{rec}", f"[{rec},]", f"[,{rec}]", f"[{rec}}}", f"[{rec}] x", f"[{rec}]]", rec[:-1], rec + rec, f"[{rec} {rec}]",
                 f'[{rec}, "', "{}]", "]", "{" * 30, f'[{rec}, {{"a": }}]', " ", "7", "[1, 2", f"[{rec}] }}", f'[{rec}] "']:
        for chunk in (1, 10**6):
            with pytest.raises(ValueError):
                _by_chunks(text.encode(), chunk)


def test_json_arrays_in_small_splits(spark, tmp_dir):
    rng, folder, wanted = random.Random(6), os.path.join(tmp_dir, "arrays"), {}
    os.makedirs(folder)
    for k in range(4):
        wanted[f"{k}.json"], data = _random_file(rng, k == 3)
        with open(os.path.join(folder, f"{k}.json"), "wb") as f:
            f.write(data)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "701")
        rows = json_arrays.read_array_elements(spark, folder, 300).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    got = {name: [] for name in wanted}
    for r in sorted(rows, key=lambda r: (r.file, r.rec_pos)):
        at = got[r.file.rsplit("/", 1)[1]]
        assert r.rec_pos == len(at)
        at.append(json.loads(r.text))
    assert got == wanted


def test_candidates_of_many_files_keep_their_order(spark, tmp_dir):
    for k in (9, 10, 100):
        with open(os.path.join(tmp_dir, f"part-{k}.csv"), "w") as f:
            f.write("Title,Abstract\n" + "".join(f"t{k}-{j},a\n" for j in range(k % 7 + 2)))
    rows = readers.read_candidates(spark, tmp_dir).orderBy("row_id").collect()
    assert [r.title for r in rows] == [f"t{k}-{j}" for k in (9, 10, 100) for j in range(k % 7 + 2)]
    assert [r.row_id for r in rows] == list(range(len(rows)))


def test_metric_report_lines(spark, tmp_dir):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 0)], "y_true int, y_pred int")
    lines = [r.line for r in sinks.report_lines(screening_metrics(df)).orderBy("ord").collect()]
    assert lines[:5] == ["tp: 1", "fp: 0", "tn: 1", "fn: 1", "recall: 0.5000"]
    sinks.write_metric_report(screening_metrics(df), os.path.join(tmp_dir, "rep"))
    assert spark.read.text(os.path.join(tmp_dir, "rep")).count() == 22


def test_stream_equals_batch(spark):
    streamed = stream_confusion_counts(spark, SF).first()
    batch = QUERIES["screening_metrics"](spark, SF).first()
    assert (streamed.tp, streamed.fp, streamed.tn, streamed.fn) == (batch.tp, batch.fp, batch.tn, batch.fn)


def test_stream_resumes_with_new_files(spark, tmp_dir):
    from revsift.plans.inputs import screening_responses, table
    from revsift.streaming.confusion import update_confusion_counts

    answers = screening_responses(spark, SF).select("doc_id", "response")
    golden = table(spark, SF, "labels")
    incoming, out, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    answers.where("doc_id < 100").write.parquet(f"{incoming}/batch1")
    first = update_confusion_counts(spark, f"{incoming}/*", golden, out, ckpt).first()
    answers.where("doc_id >= 100").write.parquet(f"{incoming}/batch2")
    second = update_confusion_counts(spark, f"{incoming}/*", golden, out, ckpt).first()
    batch = QUERIES["screening_metrics"](spark, SF).first()
    assert (second.tp, second.fp, second.tn, second.fn) == (batch.tp, batch.fp, batch.tn, batch.fn)
    assert first.tp + first.fp + first.tn + first.fn < second.tp + second.fp + second.tn + second.fn


def batch_counts(spark, pattern, golden):
    """Last answer wins over all files, in batch."""
    from revsift.streaming.confusion import ANSWER_SCHEMA, placed_answers

    rows = sorted(tuple(r) for r in placed_answers(spark.read.schema(ANSWER_SCHEMA).parquet(pattern)).select("at", "file", "row", "doc_id", "y_pred").collect())
    last = {r[3]: r[4] for r in rows}
    truth = {}
    for r in golden.collect():
        truth[r.doc_id] = max(truth.get(r.doc_id, 0), r.quality)
    pairs = [(truth[d], p) for d, p in last.items() if d in truth]
    return tuple(pairs.count(x) for x in ((1, 1), (0, 1), (0, 0), (1, 0)))


def test_later_answers_replace_earlier_ones(spark, tmp_dir):
    import random
    import time

    from revsift.streaming.confusion import update_confusion_counts

    rnd = random.Random(2)
    golden = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 1), (5, 0), (4, 1)], "doc_id long, quality int")
    incoming, out, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    zeros = update_confusion_counts(spark, f"{incoming}/*", golden, out, ckpt).first()
    assert tuple(zeros) == (0, 0, 0, 0)
    os.makedirs(incoming)
    assert tuple(update_confusion_counts(spark, f"{incoming}/*", golden, out, ckpt).first()) == (0, 0, 0, 0)
    for k in range(3):
        rows = [(rnd.randrange(70), rnd.choice(["0.9", "0.1", "N/A", "1"])) for _ in range(80)] + [(None, "0.9")]
        spark.createDataFrame(rows, "doc_id long, response string").repartition(2).write.parquet(f"{incoming}/b{k}")
        if k != 1:  # two of the folders are read in one call, by small batches
            got = update_confusion_counts(spark, f"{incoming}/*", golden, out, ckpt, bytes_per_trigger=1000)
            assert tuple(got.first()) == batch_counts(spark, f"{incoming}/*", golden)
        time.sleep(0.05)
    again = update_confusion_counts(spark, f"{incoming}/*", golden, out, ckpt)
    assert tuple(again.first()) == batch_counts(spark, f"{incoming}/*", golden)


def test_last_labels_without_a_python_call_for_each_id(spark, tmp_dir):
    """The state of a stream is an aggregate of the JVM: no id is handed to a Python worker."""
    from revsift.streaming.confusion import ANSWER_SCHEMA, confusion_of_labels, last_labels, placed_answers

    rnd = random.Random(4)
    for k in range(3):
        rows = [(rnd.randrange(40), rnd.choice(["0.9", "0.1", "N/A", "1"])) for _ in range(60)] + [(None, "0.9")]
        spark.createDataFrame(rows, ANSWER_SCHEMA).repartition(2).write.parquet(f"{tmp_dir}/in/b{k}")
    golden = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    labels = last_labels(placed_answers(spark.read.schema(ANSWER_SCHEMA).parquet(f"{tmp_dir}/in/*")))
    assert labels.count() == labels.select("doc_id").distinct().count() <= 40
    assert tuple(confusion_of_labels(labels, golden).first()) == batch_counts(spark, f"{tmp_dir}/in/*", golden.where("doc_id IS NOT NULL"))
    stream = last_labels(placed_answers(spark.readStream.schema(ANSWER_SCHEMA).parquet(f"{tmp_dir}/in/*")))
    plan = stream._jdf.queryExecution().toString()
    assert stream.isStreaming and "Aggregate" in plan and "Python" not in plan and "Pandas" not in plan


def test_named_files_round_trip(spark, tmp_dir):
    from revsift.sources.files import write_named_files

    rows = [("a.md", b"plain"), ("b.MD", "é".encode()), ("c.md", "é".encode("latin-1")), ("d.pdf", bytes(range(256))), ("e.md", None)]
    files = spark.createDataFrame(rows, "name string, content binary")
    for path in (f"{tmp_dir}/docs", f"file:{tmp_dir}/docs", f"file://{tmp_dir}/docs"):  # again: the same files
        write_named_files(files.repartition(3), path)
    assert sorted(f for f in os.listdir(f"{tmp_dir}/docs") if not f.startswith(".")) == ["_SUCCESS", "a.md", "b.MD", "c.md", "d.pdf", "e.md"]
    assert {r.title: r.full_text for r in readers.read_markdown_dir(spark, f"{tmp_dir}/docs").collect()} == {"a": "plain", "b": "é", "c": "é"}  # files of no bytes are passed over
    assert {(r.stem, r.length) for r in readers.list_documents(spark, f"{tmp_dir}/docs").collect()} == {("d", 256)}
    write_named_files(files.where("false"), f"{tmp_dir}/none")
    assert readers.list_documents(spark, f"{tmp_dir}/none").count() == 0
    for bad in ("x/y.md", "", "_hidden", None):
        with pytest.raises(Exception):
            write_named_files(spark.createDataFrame([(bad, b"")], "name string, content binary"), f"{tmp_dir}/bad")


def test_threshold_dead_letter_and_json_writers(spark, tmp_dir):
    from revsift.operators.metrics import threshold_label
    from revsift.plans.inputs import demo_scorer
    from revsift.operators.scoring import score_rows

    probs = spark.createDataFrame([(i, i / 10.0) for i in range(11)], "row_id int, probability double")
    stamped = probs.select("row_id", F.explode(F.array(F.lit(0.5), F.lit(0.8))).alias("threshold"), "probability")
    stamped = stamped.withColumn("relevance", F.when(F.col("probability") >= F.col("threshold"), 1).otherwise(0))
    sinks.write_by_threshold(stamped, f"{tmp_dir}/thr")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/thr")
    assert sorted(r.threshold for r in back.select("threshold").distinct().collect()) == [0.5, 0.8]
    assert back.where("threshold = 0.5 AND relevance = '1'").count() == 6
    assert probs.select(threshold_label("probability", 0.8).alias("l")).where("l = 1").count() == 3

    prompts = spark.createDataFrame([(i, "p") for i in range(20)], "row_id bigint, prompt string")
    scored = score_rows(prompts, demo_scorer)
    sinks.write_raw_responses(scored, f"{tmp_dir}/raw")
    sinks.write_dead_letter(spark.read.parquet(f"{tmp_dir}/raw"), f"{tmp_dir}/dead")
    assert sorted(r.row_id for r in spark.read.parquet(f"{tmp_dir}/dead").collect()) == [7, 13]
    sinks.write_json(scored.where("error IS NULL"), f"{tmp_dir}/json")
    assert spark.read.json(f"{tmp_dir}/json").count() == 18


def test_grouped_metric_report(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 0)], "g string, y_true int, y_pred int")
    sinks.write_metric_report(screening_metrics(df, group_by=["g"]), f"{tmp_dir}/rep", group_by=["g"])
    back = spark.read.text(f"{tmp_dir}/rep")
    assert back.count() == 44
    lines_a = [r.value for r in spark.read.text(f"{tmp_dir}/rep/g=a").collect()]
    assert lines_a[:4] == ["tp: 1", "fp: 0", "tn: 1", "fn: 0"]


def test_a_folder_of_small_files_is_read_by_few_tasks(spark, tmp_dir):
    """Spark gives a task a few dozen small files; tasks are put together, and every file is read once."""
    from revsift.sources import readers

    for i in range(700):
        with open(f"{tmp_dir}/doc_{i}.md", "w") as f:
            f.write(f"text {i}")
    most = 16 * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a file a task
    try:
        docs = readers.read_markdown_dir(spark, tmp_dir)
        assert docs.rdd.getNumPartitions() <= most
        assert sorted((r.title, r.full_text) for r in docs.collect()) == sorted((f"doc_{i}", f"text {i}") for i in range(700))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
