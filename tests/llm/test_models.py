"""Toxicity, mixing and the pipeline."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revsift.llm import decontam, mixing, toxicity
from revsift.llm.common import written

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, toxicity.Params(trees=8))
    rows = toxicity.score(docs.select("doc_id", "text", toxicity.held_out().alias("held")), model).join(labels, "doc_id", "left").collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    kept = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in kept) <= 0.02 * len(kept)
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.6 * len(toxic)  # some forty toxic texts to learn from


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lies = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x, toxicity.Params(trees=1)) for x in (labels, lies))
    assert (a.strong, a.mild, a.prior) == (b.strong, b.mild, b.prior)


def test_hard_rows_and_missing_classes(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(documents, none)
    rows = toxicity.score(documents.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == documents.count() and {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert toxicity.reject_toxic(documents, none).count() == documents.count()
    assert toxicity.features("", frozenset(), frozenset()) == [0.0] * len(toxicity.FEATURES)


def test_features_see_masked_words():
    names, lex = toxicity.FEATURES, frozenset({"idiot"})
    f = lambda t: dict(zip(names, toxicity.features(t, lex, frozenset()), strict=True))
    assert f("you idiot")["near_second_person"] == 1 and f("the 1d1ot and i.d.i.o.t")["masked_hits"] == 2 and f("ALL CAPS")["capitals"] == 1


def test_mixture_meets_the_targets(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    aims = spark.createDataFrame([("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2), ("xx", 0.5)], "value string, share double")
    t = mixing.mixture(docs.withColumn("weight", F.lit("mine")), mixing.Params(keep=0.4), {"lang": aims}).toPandas()
    raised = t.probability * t.weight * t.tokens
    by = raised.groupby(t.lang).sum() / raised.sum()
    assert by["en"] == pytest.approx(0.4, abs=1e-3) and by["de"] == pytest.approx(0.2, abs=1e-3)
    own = t.groupby("source").tokens.sum() ** 0.5
    assert (raised.groupby(t.source).sum() / raised.sum() - own / own.sum()).abs().max() < 1e-3
    assert (t.probability * t.tokens).sum() == pytest.approx(0.4 * t.tokens.sum(), rel=1e-3)
    assert t[t.sampled].tokens.sum() == pytest.approx(0.4 * t.tokens.sum(), rel=0.15)
    hard = mixing.mixture(documents).collect()
    assert len(hard) == documents.count() and all(0 < r["probability"] <= 1 for r in hard)
    assert mixing.mixture(documents.where("false")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        after = docs.count()
        assert 0 < after <= before
        before = after
        if name != "mixing":
            assert docs.columns == columns
        if name == "decontamination":
            assert decontam.find_passages(docs, bench).count() == 0
        if name == "personal_data":
            assert docs.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.select("doc_id").distinct().count() == before


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_hard_rows_and_empty_tables(spark, documents, tmp_dir, stage):
    """Null ids and texts, empty, repeated and long rows, extra columns named like the operators' own."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_dir}/{t}.parquet")
    names = ["component_id", "kept", "score", "predicted", "pii", "topic", "tokens", "weight", "sampled", "spans", "node", "key"]
    docs = documents.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("mine") for c in names})
    name, apply = stage
    out = apply(spark, docs, tmp_dir).collect()
    before = {r["doc_id"] for r in documents.collect()}
    assert 0 < len(out) <= documents.count() and {r["doc_id"] for r in out} <= before
    if name != "mixing":
        assert out[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
        assert {900_001, 900_002, 900_003, 900_005, None} <= {r["doc_id"] for r in out}
        assert {r[c] for r in out for c in names} == {"mine"}
    none = apply(spark, docs.where("false"), tmp_dir)
    assert none.count() == 0 and (name == "mixing" or none.columns == docs.columns)


def test_stages_with_empty_side_tables(spark, documents, tmp_dir):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_dir}/{t}.parquet")
    docs = documents.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("toxicity", "decontamination"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, tmp_dir).count() == documents.count()


def test_margins_that_clash_are_told(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x"), (2, "c d", "de", "y")], "doc_id long, text string, lang string, source string")
    share = lambda a, b: spark.createDataFrame([(a, 0.9), (b, 0.1)], "value string, share double")
    with pytest.warns(UserWarning, match="off its target"):
        rows = mixing.mixture(docs, mixing.Params(rounds=3), {"lang": share("en", "de"), "source": share("y", "x")}).collect()
    assert len(rows) == 2 and all(0 < r["probability"] <= 1 for r in rows)


def test_pipeline_is_registered(spark):
    import __spark_entry__ as E

    assert [f"op{n}_" for n in range(1, 14)] == sorted({q.split("_")[0] + "_" for q in E.queries() if q.startswith("op")}, key=lambda x: int(x[2:-1]))
    assert E.queries()["pipeline"] is corpus_pipeline.run


def test_tokens_are_words_however_parted(spark):
    texts = ["one two three", "one\ttwo\r\nthree", "one  two \n\n three ", "\x0bone\x0ctwo\u00a0same", "", " \t\n ", None]
    rows = mixing.mixture(spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()
    assert [x["tokens"] for x in sorted(rows, key=lambda x: x["doc_id"])] == [3, 3, 3, 2, 1, 1, 1]
