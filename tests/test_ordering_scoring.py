import pytest
from pyspark.sql import functions as F

from revsift.operators import pairing as P
from revsift.operators import scoring as SC
from revsift.operators.ordering import row_index, running_sum
from revsift.plans.inputs import demo_scorer


def test_row_index_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = row_index(df, ["k"], "i").collect()
    assert sorted((r.i, r.k) for r in rows) == [(i, i) for i in range(5000)]


def test_running_sum_small_blocks(spark):
    df = spark.range(0, 1000, 1, 5).select(F.col("id").alias("i"), (F.col("id") % 3).alias("v"))
    got = {r.i: r.c for r in running_sum(df, "i", "v", "c", block_size=64).collect()}
    acc = 0
    for i in range(1000):
        acc += i % 3
        assert got[i] == acc


def test_positional_pairing_and_checks(spark):
    h = spark.createDataFrame([(3, 1), (1, 0), (2, 1)], "k int, relevance int")
    a = spark.createDataFrame([(30, 1), (10, 1), (20, 0)], "k int, relevance int")
    pairs = P.pair_by_position(h, a, ["k"], ["k"], keep_human=["k"], keep_ai=["k"]).orderBy("pos").collect()
    assert [(r.human_k, r.ai_k, r.y_true, r.y_pred) for r in pairs] == [(1, 10, 0, 1), (2, 20, 1, 0), (3, 30, 1, 1)]
    assert P.length_parity(h, a).first().equal
    bad = spark.createDataFrame([(1, 2)], "k int, relevance int")
    assert P.label_domain_check(bad, ["relevance"]).first().bad_relevance == 1


def test_score_rows_isolates_failures(spark):
    df = spark.createDataFrame([(i, "p" * (i % 5)) for i in range(60)], "row_id bigint, prompt string")
    scored = SC.score_rows(df, demo_scorer, partitions=3)
    rows = {r.row_id: r for r in scored.collect()}
    assert len(rows) == 60
    assert rows[7].error and rows[7].output_text is None and rows[7].total_tokens == 0
    assert rows[8].error is None and rows[8].output_text.startswith("0.")
    classes = {r.error_class: r.n for r in SC.dead_letter(scored).groupBy("error_class")
               .agg(F.count("*").alias("n")).collect()}
    assert classes == {"rate_limit": 2, "network": 1, "other": 1}  # ids 7, 57 / 13 / 29
    tot = SC.token_totals(scored).first()
    assert tot.rows == 60 and tot.failed == 4
    run = SC.running_tokens(scored, ["row_id"]).orderBy("completed").collect()
    assert run[-1].cum_total_tokens == tot.total_tokens
    marks = SC.checkpoint_rows(SC.running_tokens(scored, ["row_id"]), 20).orderBy("completed").collect()
    assert [r.completed for r in marks] == [20, 40, 60]


def test_retry_keeps_one_row_per_input(spark):
    df = spark.createDataFrame([(i, "abc") for i in range(50)], "row_id bigint, prompt string")
    scored = SC.score_rows(df, demo_scorer)
    again = SC.retry_failed(scored, df, demo_scorer)
    assert again.count() == 50


def _counting(folder, fails):
    """A scorer that notes each call as a file and fails as told by (row id, calls so far)."""
    def scorer(rid, prompt):
        import os
        import uuid
        n = len([f for f in os.listdir(folder) if f.startswith(f"{rid}-")])
        open(os.path.join(folder, f"{rid}-{uuid.uuid4().hex}"), "w").close()
        if fails(int(rid), n):
            raise RuntimeError("Error code: 429 - rate_limit_exceeded")
        return {"output_text": f"0.{n}", "input_tokens": 1, "output_tokens": 1, "total_tokens": 2}
    return scorer


def test_every_row_is_scored_once_and_failures_again(spark, tmp_dir):
    import os
    df = spark.createDataFrame([(i, "abc") for i in range(500)], "row_id bigint, prompt string")
    _fails = lambda rid, n: (rid * 7919 + n * 104729) % 97 < 48  # noqa: E731 - about half of all calls
    scorer = _counting(tmp_dir, _fails)
    again = SC.retry_failed(SC.score_rows(df, scorer), df, scorer)
    rows = again.collect()
    first = [i for i in range(500) if _fails(i, 0)]
    left = [i for i in first if _fails(i, 1)]
    assert len(rows) == 500 and len(os.listdir(tmp_dir)) == 500 + len(first)
    assert sorted(r.row_id for r in rows if r.error) == left
    assert {r.row_id: r.output_text for r in rows if not r.error} == {i: "0.0" if i not in first else "0.1" for i in range(500) if i not in left}


def test_running_tokens_score_each_row_once(spark, tmp_dir):
    import os
    df = spark.createDataFrame([(i, "abc") for i in range(200)], "row_id bigint, prompt string")
    assert SC.running_tokens(SC.score_rows(df, _counting(tmp_dir, lambda r, n: False)), ["row_id"]).count() == 200
    assert len(os.listdir(tmp_dir)) == 200


def test_scoring_goes_on_where_it_ended(spark, tmp_dir):
    import os
    calls, table = os.path.join(tmp_dir, "calls"), os.path.join(tmp_dir, "table")
    os.makedirs(calls)
    df = spark.createDataFrame([(i, "abc") for i in range(100)], "row_id bigint, prompt string")
    never = _counting(calls, lambda r, n: False)
    SC.score_to_table(df.where("row_id < 40"), never, table)
    assert SC.score_to_table(df, never, table, blocks=3).count() == 100 and len(os.listdir(calls)) == 100
    assert SC.score_to_table(df, never, table).count() == 100 and len(os.listdir(calls)) == 100
    more = df.selectExpr("row_id + 1000 AS row_id", "prompt")
    out = SC.score_to_table(more, _counting(calls, lambda r, n: n < 2), table, rounds=5).where("row_id >= 1000")
    assert out.where("error IS NULL").count() == 100 and len(os.listdir(calls)) == 100 + 300


def test_scoring_into_absent_empty_and_half_written_folders(spark, tmp_dir):
    import os
    df = spark.createDataFrame([(i, "abc") for i in range(30)], "row_id bigint, prompt string")
    for k, there in enumerate(([], ["table"], ["table/answers"], ["table/answers/block=0-of-2-dead/_temporary/0", "table/ledger/_temporary"])):
        home = os.path.join(tmp_dir, str(k))
        calls, table = os.path.join(home, "calls"), os.path.join(home, "table")
        for folder in ("calls", *there):
            os.makedirs(os.path.join(home, folder))
        assert SC.scoring_progress(spark, table).count() == 0
        assert SC.score_to_table(df, _counting(calls, lambda r, n: False), table, blocks=2).count() == 30 and len(os.listdir(calls)) == 30
    assert SC.score_to_table(df.where("false"), _counting(calls, lambda r, n: False), table).count() == 30


def test_a_killed_block_is_all_that_is_asked_again(spark, tmp_dir):
    """The second of four blocks is killed; the next run calls the scorer for the rows that have no answer, and for no others."""
    import os
    calls, table, told = os.path.join(tmp_dir, "calls"), os.path.join(tmp_dir, "table"), []
    os.makedirs(calls)
    df = spark.createDataFrame([(i, "abc") for i in range(200)], "row_id bigint, prompt string")

    def stop(name, rows, failed):
        told.append((rows, failed))
        if len(told) == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        SC.score_to_table(df, _counting(calls, lambda r, n: False), table, blocks=4, on_block=stop)
    first = len(os.listdir(calls))
    assert 0 < first == told[0][0] < 200

    def dies(rid, prompt):  # not a failed row: the task itself ends
        raise SystemExit(1)

    with pytest.raises(Exception):
        SC.score_to_table(df, dies, table, blocks=4)
    assert [r.rows_done for r in SC.scoring_progress(spark, table).collect()] == [first]
    out = SC.score_to_table(df, _counting(calls, lambda r, n: False), table, blocks=4, on_block=lambda *x: told.append(x[1:]))
    assert sorted(r.row_id for r in out.collect()) == list(range(200)) and len(os.listdir(calls)) == 200
    progress = SC.scoring_progress(spark, table).orderBy("rows_done").collect()
    assert progress[-1].rows_done == 200 == sum(r.rows for r in progress) and sum(n for n, _ in told) == 200


def test_blocks_of_rows_and_kept_columns(spark, tmp_dir):
    df = spark.createDataFrame([(str(i), "abc", i % 3, i) for i in range(90)], "row_id string, prompt string, lang int, attempt_of int")
    out = SC.score_to_table(df, lambda rid, p: {"output_text": p + rid}, f"{tmp_dir}/t", keep=["lang"], block_rows=25)
    assert {(r.row_id, r.lang, r.output_text) for r in out.collect()} == {(str(i), i % 3, f"abc{i}") for i in range(90)}
    assert SC.scoring_progress(spark, f"{tmp_dir}/t").count() == 4


def test_shards_round_robin(spark):
    df = spark.createDataFrame([(i,) for i in (5, 1, 9, 3)], "row_id int")
    got = {r.row_id: r.shard for r in SC.assign_shards(df, ["row_id"], 2).collect()}
    assert got == {1: 0, 3: 1, 5: 0, 9: 1}


def test_scoring_by_shard(spark):
    df = spark.createDataFrame([(i, "abc") for i in range(40)], "row_id bigint, prompt string")
    sharded = SC.assign_shards(df, ["row_id"], 4)

    def scorer(rid, prompt, shard):
        assert shard == rid % 4  # round robin by position; positions equal ids here
        return {"output_text": f"key{shard}", "input_tokens": 1, "output_tokens": 1, "total_tokens": 2}

    out = SC.score_rows(sharded, scorer, partitions=4, shard_col="shard")
    rows = out.collect()
    assert len(rows) == 40 and all(r.error is None and r.output_text == f"key{r.shard}" for r in rows)


def test_running_tokens_restart_per_run(spark):
    rows = [(run, i, 10 * run + i) for run in (1, 2) for i in range(5)] + [(3, 0, 7)]
    df = spark.createDataFrame(rows, "run int, row_id bigint, total_tokens bigint") \
        .withColumn("input_tokens", F.lit(1).cast("bigint")).withColumn("output_tokens", F.lit(None).cast("bigint"))
    got = {(r.run, r.row_id): (r.completed, r.cum_total_tokens, r.cum_input_tokens, r.cum_output_tokens)
           for r in SC.running_tokens(df, ["row_id"], block_size=3, run_col="run").collect()}
    assert got[(1, 4)] == (5, 10 + 11 + 12 + 13 + 14, 5, 0)
    assert got[(2, 0)] == (1, 20, 1, 0)
    assert got[(2, 4)] == (5, 20 + 21 + 22 + 23 + 24, 5, 0)
    assert got[(3, 0)] == (1, 7, 1, 0)


def test_scoring_holds_few_rows_as_python_values(spark):
    """Batches of the session may be large; the worker takes SCORED_ROWS rows at a time, and kept columns keep their values."""
    from pyspark.sql import functions as F

    from revsift.operators import scoring as S

    def scorer(row_id, prompt):
        if row_id % 5 == 0:
            return {"output_text": "half", "input_tokens": "many"}  # fails after the text was read
        return {"output_text": prompt, "input_tokens": 1, "output_tokens": 2, "total_tokens": 3}

    rows = spark.range(0, 1000, 1, 1).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), F.col("id")).alias("prompt"),
                                             F.when(F.col("id") % 2 == 0, F.lit(2**60 + 1)).alias("kept"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        scored = S.score_rows(rows, scorer, keep=["kept"])
        got = {r.row_id: r for r in scored.collect()}
        assert "MapInArrow" in scored._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(got[i].kept == (2**60 + 1 if i % 2 == 0 else None) for i in range(1000))
    assert all((got[i].output_text, got[i].total_tokens, got[i].error is None) == ((None, 0, False) if i % 5 == 0 else (f"p{i}", 3, True)) for i in range(1000))
