"""Personal data by weak supervision (operator 1, DataFrame functions only).

Patterns propose spans. Labelers (shape, gazetteers, cue words, boundaries)
vote on every span; expectation-maximisation estimates how reliable each
labeler is; the resulting soft labels train a naive Bayes span classifier over
the kind, the votes and a few features of the span. Spans of the four base
kinds are always reported; those of the looser kinds only if the classifier
accepts them.

Defined cases: a null or empty text has no spans; every row gets its own result,
repeated rows and null ids too; other columns pass through, but for those named
like the results, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import let, scratch, total, whole_text, written
from revsift.llm.em import Votes, fit_votes

# The base kinds in their order, then the looser ones. A possessive quantifier, a
# look-behind for the run's start or \G (the end of the match before) change no match of the
# plain patterns; they only keep a long run of one class from being tried from each of its places.
BASE = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z]{2,24}",
    "local_phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
    "address": r"(?<![0-9])[0-9]{1,5}\x20\p{Lu}\p{Ll}{1,30}\x20(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard)(?![\p{L}])",
}
KINDS = list(PATTERNS)
# what a text must hold for a pattern to be worth trying
NEEDS = {"email": "@", "phone": r"\+[0-9]", "masked_email": r"[\[(](?i:at)[\])]", "person": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20"}
# Gazetteers and cue words of the labelers.
DOMAINS = r"(?i)[.\x20)\]](com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us)$"
CUES = r"(?i)(mail|contact|e-?mail|phone|tel|call|fax|mobile|card|visa|account|iban|ssn|address|ip|host|server|name|from|to|write)\W{0,12}$"
COUNTER_CUES = r"(?i)(version|release|section|isbn|issn|page|figure|table|order|invoice|build|licen[cs]e|chapter|no|nr)\W{0,8}$"
VOTERS = ["v_shape", "v_gazetteer", "v_context", "v_boundary", "v_variety"]
FEATURES = ["kind", *VOTERS, "length", "groups"]
LEFT, RIGHT = "\x01", "\x02"


def starts(lengths: Column, block: int = 64) -> Column:
    """Running sum before each element, by sums of blocks first so that long lists stay cheap."""
    def within(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")),
                             lambda b: total(F.slice(all_, b * block + 1, block)))
        offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return let(offsets, lambda o: F.transform(all_, lambda _, i: F.get(o, F.floor(i / block).cast("int"))
                   + total(F.slice(all_, F.floor(i / block).cast("int") * block + 1, i % block))))

    return let(lengths, within)


def find_spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind's pattern, with 40 characters before and 1 after.

    The pattern is replaced by itself between two marks; the pieces between
    the marks give the places. Marks that the text itself holds become another
    control character first, which no pattern takes; all lengths stay."""
    marked = F.regexp_replace(F.translate(text, LEFT + RIGHT, "\x03\x03"), PATTERNS[kind], LEFT + "$0" + RIGHT)

    def spans(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p, i: F.when(i == 0, F.length(p)).otherwise(F.length(p) - 1))
        return let(starts(sizes), lambda at: F.filter(F.transform(pieces, lambda p, i: let(
            F.substring_index(p, RIGHT, 1), lambda value: F.struct(
                F.get(at, i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (F.get(at, i) + F.length(value)).alias("end"), value.alias("value"),
                F.right(F.get(pieces, i - 1), F.lit(40)).alias("before"),
                F.substring(F.substring(p, F.length(value) + F.lit(2), F.lit(1)), 1, 1).alias("after")))),
            lambda s: s["before"].isNotNull()))

    empty = "array<struct<start:int,kind:int,end:int,value:string,before:string,after:string>>"
    needed = text.rlike(NEEDS.get(kind, "[0-9]"))
    return F.when(needed, F.filter(let(F.split(marked, LEFT), spans), lambda s: valid(kind, s["value"]))).otherwise(F.array().cast(empty))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    def of_digits(d: Column) -> Column:
        ones = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(
            (F.ascii(c) - 48) * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
        return F.length(d).between(12, 19) & (total(F.slice(ones, 1, 19)) % 10 == 0)

    return let(digits(value), of_digits)


def valid(kind: str, value: Column) -> Column:
    """The checks of a base kind; a match that fails them is dropped."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def votes(s: Column) -> dict[str, Column]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing."""
    value, before, after, kind = s["value"], s["before"], s["after"], s["kind"]
    is_ = lambda *k: kind.isin([KINDS.index(x) for x in k])
    n = F.length(digits(value))
    shape = (F.when(is_("email"), F.when(value.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@.*\.[A-Za-z]{2,24}$"), 1).otherwise(-1))
             .when(is_("card"), F.when(n.between(13, 19) & value.rlike("^[3-6]"), 1).otherwise(-1))
             .when(is_("phone", "local_phone"), F.when(n.between(10, 14), 1).otherwise(-1))
             .when(is_("ip"), F.when(value.rlike(r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$"), 1).otherwise(-1))
             .when(is_("national_id"), F.when(value.rlike("^(000|666|9)|-00-|-0000$"), -1).otherwise(1))
             .when(is_("iban"), F.when(F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34), 1).otherwise(-1))
             .otherwise(0))
    gazetteer = (F.when(is_("email", "masked_email"), F.when(value.rlike(DOMAINS), 1).otherwise(-1))
                 .when(is_("phone"), F.when(value.rlike(r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 1).otherwise(-1))
                 .when(is_("ip"), F.when(value.rlike(r"^(0|127|255)\."), -1).otherwise(1))
                 .when(is_("person", "address"), 1).otherwise(0))
    context = F.when(before.rlike(COUNTER_CUES), -1).when(before.rlike(CUES), 1).otherwise(0)
    boundary = F.when(before.rlike(r"[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"), -1).otherwise(1)
    variety = F.when(is_("person", "address", "masked_email"), 0).when(F.size(F.array_distinct(F.split(value, ""))) >= 6, 1).otherwise(-1)
    return dict(zip(VOTERS, (shape, gazetteer, context, boundary, variety), strict=True))


def features(s: Column) -> dict[str, Column]:
    return {"length": F.least(F.floor(F.length(s["value"]) / 4), F.lit(8)).cast("int"),
            "groups": F.least(F.size(F.split(s["value"], "[^A-Za-z0-9]+")), F.lit(7))}


def train_span_classifier(spans: DataFrame, model: Votes) -> dict[str, dict]:
    """Naive Bayes by posterior-weighted counts: for each value of a feature the log of its odds.

    One aggregation; its result has at most (kinds + votes + bins) rows."""
    p = F.expr(model.posterior())
    rows = (spans.select(p.alias("p"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in FEATURES])).alias("x"))
            .groupBy("x.feature", "x.value").agg(F.sum("p").alias("one"), F.sum(1 - F.col("p")).alias("zero")).collect())
    of = lambda f: [r for r in rows if r["feature"] == f]
    one, zero = (sum(r[c] for r in of("kind")) for c in ("one", "zero"))
    out = {"prior": {None: math.log((one + 1) / (zero + 1))}}
    for f in FEATURES:
        k = len(of(f)) + 1
        out[f] = {r["value"]: math.log((r["one"] + 1) / (one + k)) - math.log((r["zero"] + 1) / (zero + k)) for r in of(f)}
    return out


def probability(fitted: dict[str, dict], of: str) -> str:
    """SQL: the classifier's probability that the span ``of`` is personal."""
    odds = [repr(fitted["prior"][None])] + [
        f"CASE {of}.{f} " + " ".join(f"WHEN {value} THEN {weight!r}" for value, weight in sorted(fitted[f].items())) + " ELSE 0 END"
        for f in FEATURES if fitted[f]]
    return f"(1 / (1 + exp(-double({' + '.join(odds)}))))"


def seen_spans(text: Column) -> Column:
    """All proposed spans of a text with their votes and features."""
    found = let(text, lambda t: F.concat(*[find_spans(t, k) for k in KINDS]))
    return F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"],
                       *[v.alias(k) for k, v in {**votes(s), **features(s)}.items()]))


def fit(spans: DataFrame) -> dict[str, dict]:
    """The span classifier, from a table with the column ``_spans``."""
    each = spans.where(F.size("_spans") > 0).select(F.inline("_spans"))
    return train_span_classifier(each, fit_votes(each, VOTERS, prior=0.7))


def with_personal_data(spans: DataFrame, fitted: dict[str, dict], threshold: float) -> DataFrame:
    """``spans`` with ``pii`` in place of ``_spans``."""
    rest = [c for c in spans.columns if c != "_spans"]
    judged = F.expr(f"transform(_spans, s -> struct(s.start, s.kind, s.end, s.value, s.kind < {len(BASE)} AS base, {probability(fitted, 's')} AS p))")
    base = F.filter("_judged", lambda s: s["base"])
    # a looser span that only repeats part of a base span says nothing new
    loose = F.filter("_judged", lambda s: ~s["base"] & (s["p"] >= threshold) & ~F.exists("_base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    return (spans.withColumn("_judged", judged).withColumn("_base", base)
            .select(*rest, F.sort_array(F.concat("_base", loose)).alias("pii")))


def find_personal_data(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the text column, with ``pii``: an array, by start and kind, of
    (start, kind, end, value, base, p). The places are code points, the end exclusive;
    ``kind`` is an index of KINDS; ``p`` is the classifier's probability. All spans of
    the base kinds are there, those of other kinds from ``threshold`` on."""
    rest = [c for c in docs.columns if c not in {text_col, "pii"}]
    spans = written(docs.select(*rest, seen_spans(whole_text(text_col)).alias("_spans")), "pii")
    return with_personal_data(spans, fit(spans), threshold)


def kind_name(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), kind)


def digest_columns(found: DataFrame, keys: list[str]) -> DataFrame:
    """The counts and digests of a result of ``find_personal_data``."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(pii, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select(*keys, *counts, F.sha2(told(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets.

    Spans that overlap count as one, named after the first. Spans are proposed
    twice, to fit the classifier and to redact, so that no text is written."""
    seen = seen_spans(whole_text(text_col)).alias("_spans")
    with scratch(docs.sparkSession):
        fitted = fit(written(docs.select(seen), "pii"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    found = with_personal_data(docs.select(row, seen), fitted, threshold)
    text = F.col("_row")[text_col]

    def one(acc: Column, s: Column) -> Column:
        put = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + F.lit(1), s["start"] - acc["at"]),
                                F.lit("["), F.upper(kind_name(s["kind"])), F.lit("]")).alias("out"), s["end"].alias("at"))
        longer = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], put).otherwise(longer)

    clean = F.aggregate("pii", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), one,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + F.lit(1), F.length(text))))
    return found.select(*[F.when(F.size("pii") == 0, text).otherwise(clean).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
