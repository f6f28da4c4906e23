"""Quality rules, token counts and line removal against plain Python."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revsift.llm import quality, token_counts, unit_dedup
from revsift.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    words, lines = re.findall(WORD, text or ""), [x for x in (text or "").split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    hit = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(documents, texts):
    rows = quality.judge_quality(documents.withColumn("quality", F.lit("mine"))).collect()
    key = lambda d, c: (str(d), *c)
    got = sorted(key(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows)
    assert got == sorted(key(d, plain_counts(t)) for d, t in texts)
    for r in rows:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"]) and 0 <= r["quality"] <= 1


def test_repeated_words_of_small_vocabularies(spark):
    r = random.Random(3)
    texts = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(200)]
    got = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", quality.repeated_words(F.filter(F.split("text", " "), lambda w: w != "")).alias("n")).collect()
    assert {x["doc_id"]: x["n"] for x in got} == {d: plain_counts(t)[4] for d, t in texts}


def test_quality_follows_the_labels(spark):
    """On both halves of the labels, which no rule and no fit has seen: bad texts go, good ones that pass the base limits stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge_quality(docs.select("doc_id", "text")).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    for half in (0, 1):
        bad = [r["kept"] for r in rows if r["y"] == 0 and r["doc_id"] % 2 == half]
        good = [r["kept"] for r in rows if r["y"] == 1 and r["doc_id"] % 2 == half and not r["base_failed"]]
        assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.97 * len(good) and min(len(bad), len(good)) > 20
    # the verdict is not that of the base limits
    assert sum(not r["kept"] and not r["base_failed"] for r in rows if r["y"] == 0) >= 20


def test_rules_vote_on_evidence_only(spark):
    """A rule objects, or it abstains; what it finds broken in one respect is not outvoted by all that is not broken in others."""
    prose = " ".join(f"Plain words make up sentence {chr(97 + i % 26)} here." for i in range(30))
    soup = prose.replace(" ", "### ").replace("a", "$$$")
    rows = [(i, prose + f" Number {i}.") for i in range(40)] + [(100 + i, soup + f" {i}") for i in range(6)]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(6)) and all(got[100]["v_symbols"] == -1 and got[0][v] >= 0 for v in quality.VOTERS[:5])


def test_quality_without_rows(documents):
    assert quality.judge_quality(documents.where("false")).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(documents, texts, spark, name):
    path, cache = public_tokenizers.path(name), scratch_path(spark, "test-cache")
    if name.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        tk = Tokenizer.from_file(path)
        count = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    some = documents.where("doc_id % 2 = 0 OR doc_id IS NULL")
    token_counts.count_tokens(some, cache, path).collect()
    first = token_counts.read_cache(spark, cache).count()
    assert first == len({t or "" for d, t in texts if d is None or d % 2 == 0})
    got = token_counts.count_tokens(documents, cache, path).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(
        (str(d), len((t or "").encode()), count(t or ""), count(t or "") > 4096) for d, t in texts)
    # what was known was not encoded again: every digest is in the files once
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.distinct().count() == len({t or "" for _, t in texts})
    assert token_counts.count_tokens(documents.where("false"), cache, path).count() == 0


def test_cache_tells_tokenizers_apart():
    marks = {token_counts.tokenizer_digest(n, b) for n, b in (("a.model", b"x"), ("a.model", b"y"), ("a.json", b"x"))}
    assert len(marks) == 3


def test_lines_against_plain_python(spark, documents, texts):
    rows = unit_dedup.remove_repeated_units(documents.withColumn("removed", F.lit("mine"))).collect()
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    first = {}
    for d, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            first.setdefault(norm(line), (d, t, k))
    want = []
    for d, t in texts:
        at, kept, gone = 0, [], []
        for k, line in enumerate((t or "").split("\n")):
            if norm(line) and first[norm(line)] != (d, t, k):
                gone.append((at, at + len(line)))
            else:
                kept.append(line)
            at += len(line) + 1
        want.append((str(d), None if t is None else "\n".join(kept), gone))
    assert sorted(map(str, ((str(r["doc_id"]), r["text"], [tuple(s) for s in r["removed"]]) for r in rows))) == sorted(map(str, want))
    assert all(r["n_removed"] == len(r["removed"]) for r in rows)
    assert unit_dedup.remove_repeated_units(documents.where("false")).count() == 0


def test_offsets_cut_the_original(spark):
    docs = spark.createDataFrame([(1, "é one\nTwo  words\n\n😀 x"), (2, "two WORDS\n😀 x\nnew")], "doc_id long, text string")
    r = unit_dedup.remove_repeated_units(docs).where("doc_id = 2").first()
    assert ["two WORDS\n😀 x\nnew"[a:b] for a, b in r["removed"]] == ["two WORDS", "😀 x"] and r["text"] == "new"
