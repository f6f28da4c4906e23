"""Toxicity by gradient-boosted trees over dense features (operator 7).

Labelled rows of the training side are split by a hash of their id into three
parts. On the first, words get log odds of being in a toxic text, and the
strongest make the lexicon. On the second, boosted trees learn from lexicon
densities, closeness of lexicon words to second-person words, capitals,
punctuation and obfuscation rates. The third calibrates their margin by
isotonic regression. No part sees another's rows, so neither the lexicon nor the
calibration is fitted to what the trees have memorised.

Rows whose crc32(id as text) mod 5 is 0 are held out: their labels are never
read. At most about ``max_rows`` labelled rows, chosen by a hash of the id, are
used to fit; scoring covers every row and the whole text.

Defined cases: a null or empty text has zeros as features and is scored like
others. A null id counts as held out. A document with several labels is toxic
if one says so; null labels are ignored. If the labels lack one of the classes
in one of the parts, every score is the share of toxic labels (0 without any).
Repeated rows and other columns pass through; columns named like the results
are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import whole_text, written

FEATURES = ["strong_density", "mild_density", "strong_count", "strong_kinds", "second_person", "near_second_person",
            "capitals", "exclamations", "questions", "punctuation", "digits", "masked_hits", "masked_rate", "spaced_rate", "stretched_rate", "length"]
# Second-person words of the languages in the corpus, and letters by the signs that stand for them.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus vosotros".split())
SIGNS = [str.maketrans("013457@$!|*", x) for x in ("oleastasil ", "oieastasii ")]  # 1 and | stand for l or i
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"(?<![A-Za-z])[A-Za-z]*+[0134578@$!|*]+[A-Za-z][0134578@$!|*A-Za-z]*+")
SPACED = re.compile(r"\b[a-z](?:[ .*_-][a-z]){3,}\b")
STRETCHED = re.compile(r"([a-z])\1\1")


@dataclass(frozen=True)
class Params:
    max_rows: int = 20_000
    max_words: int = 400  # of each lexicon
    least_docs: int = 4
    strong: float = 2.5  # log odds
    mild: float = 1.0
    trees: int = 20
    depth: int = 3


@dataclass(frozen=True)
class Model:
    strong: frozenset[str]
    mild: frozenset[str]
    trees: Any
    isotonic: Any
    prior: float


def features(text: str, strong: frozenset[str], mild: frozenset[str]) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters, chars = max(1, int(hist[65:91].sum() + hist[97:123].sum())), max(1, int(hist.sum()))
    hits = [i for i, w in enumerate(words) if w in strong]
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - 4) : i + 5]) for i in hits)
    masked, spaced = MASKED.findall(low), SPACED.findall(low)
    plain = [{m.translate(t).replace(" ", "") for t in SIGNS} for m in masked] + [{re.sub("[^a-z]", "", s)} for s in spaced]
    return [100 * len(hits) / n, 100 * sum(w in mild for w in words) / n, float(len(hits)), float(len({words[i] for i in hits})),
            100 * sum(w in SECOND_PERSON for w in words) / n, near / max(1, len(hits)), hist[65:91].sum() / letters,
            100 * hist[33] / n, 100 * hist[63] / n, (hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum()) / chars, hist[48:58].sum() / chars,
            float(sum(not strong.isdisjoint(x) for x in plain)), 100 * len(masked) / n, 100 * len(spaced) / n, 100 * sum(1 for _ in STRETCHED.finditer(low)) / n,
            float(np.log1p(len(words)))]


def feature_column(text: Column, strong: frozenset[str], mild: frozenset[str]) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t, strong, mild) for t in batch])

    return of(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    p = p or Params()
    given = (labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IS NOT NULL")
             .where(~held_out("_id")).groupBy("_id").agg(F.max("toxic").cast("double").alias("label")))
    n, toxic = given.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    spread = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), F.col("_id")), F.lit(parts))
    if n > p.max_rows:
        given = given.where(spread("rows", 1_000_000) < int(1_000_000 * p.max_rows / n))
    given = given.withColumn("part", F.when(spread("part", 5) < 2, "words").when(spread("part", 5) < 4, "trees").otherwise("scale"))
    # of bounded size, by max_rows; written, since several jobs read it
    rows = written(docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(given), "_id")
                   .select("part", "label", "_text"), "labelled")
    prior = toxic / n if n else 0.0

    seen = rows.where("part = 'words'").dropDuplicates(["_text"]).select("label", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("_text"), F.lit(r"([\p{L}]+)"), F.lit(1)))).alias("word"))
    sizes = rows.where("part = 'words'").dropDuplicates(["_text"]).agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    strong, mild = frozenset(), frozenset()
    if sizes[0] and sizes[1]:
        odds = F.log((F.col("t") + 0.5) / (sizes[0] + 1)) - F.log((F.col("c") + 0.5) / (sizes[1] + 1))
        told = (seen.groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where(f"t >= {p.least_docs}")
                .withColumn("odds", odds).where(f"odds >= {p.mild}").withColumn("strong", F.col("odds") >= p.strong))
        pick = lambda c: frozenset(r["word"] for r in told.where(c).orderBy(F.desc(F.col("t") * F.col("odds")), "word").limit(p.max_words).collect())
        strong, mild = pick("strong"), pick("NOT strong")

    points = (rows.where("part <> 'words'").select("part", "label", feature_column(F.col("_text"), strong, mild).alias("f"))
              .select("part", "label", array_to_vector("f").alias("features")).persist())
    try:
        classes = {(r["part"], r["label"]) for r in points.select("part", "label").distinct().collect()}
        if len(classes) < 4:
            return Model(strong, mild, None, None, float(prior))
        trees = GBTClassifier(maxIter=p.trees, maxDepth=p.depth, maxBins=32, stepSize=0.2, seed=7, featuresCol="features", labelCol="label").fit(points.where("part = 'trees'"))
        scale = trees.transform(points.where("part = 'scale'")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(scale)
    finally:
        points.unpersist()
    return Model(strong, mild, trees, isotonic, float(prior))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` between 0 and 1 and ``predicted`` (1 from 0.5 on)."""
    rest = [c for c in docs.columns if c not in {"score", "predicted"}]
    if model.trees is None:
        return docs.select(*rest, F.lit(model.prior).alias("score"), F.lit(int(model.prior >= 0.5)).alias("predicted"))
    own = F.struct(*[F.col(c) for c in rest]).alias("_row")  # apart from the names that the models add
    points = docs.select(own, array_to_vector(feature_column(whole_text(text_col), model.strong, model.mild)).alias("features"))
    margins = model.trees.transform(points).select("_row", vector_to_array("rawPrediction")[1].alias("margin"))
    scored = model.isotonic.transform(margins)
    return scored.select("_row.*", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic; same columns, also those named like the results of ``score``."""
    model = train(docs, labels, p, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_whole"), F.col(text_col).alias("_text"))
    return score(rows, model, "_text").where("predicted = 0").select("_whole.*")
