"""Secrets by patterns and a character network (operator 2).

Patterns find the base spans and, more loosely, further candidates: runs of
token characters that mix classes. A small convolutional network, written and
trained in numpy, reads every candidate together with the characters around
it. It learns from labelled findings; part of them is set aside to scale its
output to a probability (Platt) and to choose the highest threshold, at most one
half, that still finds the required share of the secrets. Base spans are always
reported; further candidates from the threshold on.

Where a table has no labelled findings they are made from it: rules label some
candidates, and random keys in shapes that vendors use are planted between
words of the texts, beside slugs and paths of the texts' own words with a number,
so that the shape of a run alone does not tell its label.

Training uses at most ``max_findings`` findings of each class, chosen by hash,
and of those that are not secrets the first ``longest`` characters; longer
secrets are not trained on. Every candidate of every whole text is scored, long
ones in overlapping views whose best score counts.

Defined cases: a null or empty text has no spans; each row gets a row, repeated
ones and null ids too; other columns pass through, but for those named like the
results. If the findings lack one of the classes, only base spans are reported.
Empty tables give empty results. Found values are written nowhere but for the
findings, whose table is deleted once the network is fitted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import scratch, whole_text, written

# The base kinds in their order.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "token"]
# letters in either case, without the foreign letters that ignoring case would add
_CASE = lambda w: "".join(f"[{c.upper()}{c}]" for c in w)
_NAMES = "|".join([*map(_CASE, ("password", "passwd", "secret", "token")), _CASE("api") + "_?" + _CASE("key")])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # of the runs only those of 16 or more count, and a run is one match
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SPANS = "array<struct<start:int,kind:int,end:int,value:string,before:string,after:string>>"
# How keys of common services begin, and the length of their random part.
SHAPES = [("ghp_", 36), ("glpat-", 20), ("sk_live_", 24), ("AIza", 35), ("npm_", 36), ("xoxb-", 24), ("SG.", 22), ("", 24), ("", 32), ("", 40)]


@dataclass(frozen=True)
class Params:
    max_findings: int = 4000  # of each class
    value: int = 48  # characters of a view of a candidate
    longest: int = 1024  # of a finding to train on
    context: int = 24  # characters before it
    after: int = 8
    embed: int = 8
    filters: int = 24
    width: int = 5
    epochs: int = 6
    recall: float = 0.98

    @property
    def length(self) -> int:
        return self.value + self.context + self.after + 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What base spans leave of runs of token characters: parts of 16 or more, with digits and letters."""
    out, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        parts, at = [], max(m.start(), reach)
        while k < len(base) and base[k][0] < m.end():
            parts.append((at, base[k][0]))
            reach = max(reach, base[k][2])
            at = max(at, reach)
            k += 1
        for a, b in [*parts, (at, m.end())]:
            run = text[a:b].strip(".-=/+")
            if len(run) >= 16 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                a = text.index(run, a)
                out.append((a, 3, a + len(run)))
    return out


def views(before: str, value: str, after: str, p: Params) -> list[tuple[str, str, str]]:
    """The value in overlapping pieces, each with what stands around it; a short value is one."""
    last, whole = len(value) - p.value, before + value + after
    if last <= 0:
        return [(before, value, after)]
    at = [len(before) + k for k in [*range(0, last, p.value // 2), last]]
    return [(whole[max(0, k - p.context) : k], whole[k : k + p.value], whole[k + p.value : k + p.value + p.after]) for k in at]


def all_spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted([*base, *loose_spans(text, base)])


def seen(text: str, a: int, b: int, p: Params) -> tuple[str, str, str]:
    """What stands before a span, its value, and what stands after it."""
    return text[max(0, a - p.context) : a], text[a:b], text[b : b + p.after]


def find_candidates(text: Column, p: Params) -> Column:
    """The base and looser spans of a text, with what stands around them."""

    @F.pandas_udf(SPANS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"start": a, "kind": k, "end": b, **dict(zip(("before", "value", "after"), seen(t, a, b, p), strict=True))}
                              for a, k, b in all_spans(t)] for t in batch])

    return of(text)


def encoded(before: list[str], value: list[str], after: list[str], p: Params) -> np.ndarray:
    """Rows of character codes: 0 nothing, 1 a mark around the value, 2 any character beyond ASCII."""
    out = np.zeros((len(value), p.length), np.int64)
    for i, (b, v, a) in enumerate(zip(before, value, after, strict=True)):
        c = [ord(x) if ord(x) < 128 else 2 for x in b[-p.context:].rjust(p.context, "\0")] + [1]
        c += [ord(x) if ord(x) < 128 else 2 for x in v[: p.value]] + [1] + [ord(x) if ord(x) < 128 else 2 for x in a[: p.after]]
        out[i, : len(c)] = c
    return out


class Network:
    """Embedding, one convolution, max and mean pooling, one linear output."""

    def __init__(self, p: Params, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = p
        self.w = {"e": rng.normal(0, 0.3, (128, p.embed)), "c": rng.normal(0, 1 / math.sqrt(p.embed * p.width), (p.width * p.embed, p.filters)),
                  "b": np.zeros(p.filters), "o": rng.normal(0, 0.1, 2 * p.filters), "z": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def forward(self, x: np.ndarray):
        p, w = self.p, self.w
        e = w["e"][x]
        n = x.shape[1] - p.width + 1
        windows = np.concatenate([e[:, j : j + n] for j in range(p.width)], axis=2)
        h = np.maximum(windows @ w["c"] + w["b"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return pooled @ w["o"] + w["z"][0], (windows, h, top, pooled)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, w = self.p, self.w
        logit, (windows, h, top, pooled) = self.forward(x)
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dp = np.outer(d, w["o"])
        dh = np.repeat(dp[:, None, p.filters:] / h.shape[1], h.shape[1], axis=1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, : p.filters], 1)
        dh *= h > 0
        flat = dh.reshape(-1, p.filters)
        de_windows = (flat @ w["c"].T).reshape(windows.shape)
        de = np.zeros((*x.shape, p.embed))
        for j in range(p.width):
            de[:, j : j + windows.shape[1]] += de_windows[:, :, j * p.embed : (j + 1) * p.embed]
        ge = np.zeros_like(w["e"])
        np.add.at(ge, x.ravel(), de.reshape(-1, p.embed))
        return {"e": ge, "c": windows.reshape(-1, windows.shape[2]).T @ flat, "b": flat.sum(0), "o": pooled.T @ d, "z": d.sum(keepdims=True)}

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        """Adam over small batches in which both classes weigh the same."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        t = 0
        one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        steps = self.p.epochs * max(20, -(-max(len(one), len(zero)) // 64))
        for _ in range(steps):
            t += 1
            rows = np.r_[rng.choice(one, 32), rng.choice(zero, 32)]
            for k, g in self.gradients(x[rows], y[rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, first: np.ndarray | None = None, decided: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps, then the highest threshold up to one half that keeps the recall.

        ``first``: where the views of each finding begin. ``decided``: the findings that the
        threshold decides on; where there are secrets among them, their recall counts."""
        s = np.clip(self.logits(x), -30, 30)
        s = s if first is None else np.maximum.reduceat(s, first)
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        line = np.stack([s, np.ones_like(s)], axis=1)
        loss = lambda c: (np.logaddexp(0, line @ c) - t * (line @ c)).sum() + 5e-4 * c[0] ** 2
        c = np.array([1.0, 0.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(line @ c, -500, 500)))
            slope = line.T @ (q - t) + [1e-3 * c[0], 0]
            step = np.linalg.solve((line * (q * (1 - q) + 1e-6)[:, None]).T @ line + 1e-6 * np.eye(2), slope)
            size = 1.0
            while loss(c - size * step) > loss(c) and size > 1e-6:
                size /= 2
            c = c - size * step
        a, b = c
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        one = y == 1 if decided is None or not (decided & (y == 1)).any() else decided & (y == 1)
        found = np.sort(self.scaled(s[one]))
        self.threshold = min(0.5, float(found[int((1 - self.p.recall) * len(found))]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *(self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512))])

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * np.clip(logits, -30, 30) + self.shift, -500, 500)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(x))

    def best(self, candidates: list[tuple[str, str, str]]) -> np.ndarray:
        """The probability of each (before, value, after): that of its best view."""
        out, held = np.zeros(len(candidates)), []

        def put() -> None:
            if held:
                q = self.probability(encoded(*(list(c) for c in zip(*(v for _, v in held), strict=True)), self.p))
                np.maximum.at(out, [i for i, _ in held], q)
                held.clear()

        for i, c in enumerate(candidates):
            for v in views(*c, self.p):
                held.append((i, v))
                if len(held) == 4096:
                    put()
        put()
        return out


def fit_network(findings: DataFrame, p: Params) -> Network | None:
    """A network from ``findings(before, value, after, label)``; None if a class is missing.

    A column ``origin`` tells findings of different making apart: those of one class
    share its sample evenly. Only the sample comes to the driver: at most about
    2 * ``max_findings`` strings of at most ``longest`` characters."""
    origin = F.col("origin") if "origin" in findings.columns else F.lit("")
    value = F.when(F.col("label") == 1, F.col("value")).otherwise(F.left("value", F.lit(p.longest))).alias("value")
    distinct = (findings.where("label IN (0, 1)").where((F.col("label") == 0) | (F.length("value") <= p.longest))
                .select("before", value, "after", F.col("label").cast("int").alias("label"), origin.alias("origin")).distinct())
    sizes = {(r["label"], r["origin"]): r["count"] for r in distinct.groupBy("label", "origin").count().collect()}
    if {label for label, _ in sizes} != {0, 1}:
        return None
    share = F.lit(0.0)
    for (label, made), n in sizes.items():
        each = p.max_findings / sum(label == other for other, _ in sizes)
        share = F.when((F.col("label") == label) & F.col("origin").eqNullSafe(F.lit(made)), min(1.0, each / n)).otherwise(share)
    u = F.pmod(F.xxhash64("before", "value", "after"), F.lit(1_000_003)) / 1_000_003
    rows = distinct.withColumn("u", u).where(F.col("u") < share).orderBy("u", "before", "value", "after", "label").toPandas()
    cut = [views(b, v, a, p) for b, v, a in rows[["before", "value", "after"]].itertuples(index=False)]
    first = np.cumsum([0, *map(len, cut)])
    x = encoded(*(list(c) for c in zip(*(v for each in cut for v in each), strict=True)), p)
    y = rows["label"].to_numpy(float)
    decided = np.array([not any(a == 0 and b == len(v) for a, _, b in base_spans(v)) for v in rows["value"]])
    aside = np.arange(len(y)) % 4 == 3
    if not all(set(y[part]) == {0.0, 1.0} for part in (aside, ~aside)):
        aside = np.zeros(len(y), bool)  # too few to set any aside
    network = Network(p)
    of = np.repeat(np.arange(len(y)), np.diff(first))
    learnt, one = ~aside[of], y[of] == 1
    sure = ~one | (np.diff(first)[of] == 1)  # in which view of a long secret the key stands is not known yet
    if not (learnt & one & sure).any():
        sure[:] = True
    network.train(x[learnt & sure], y[of][learnt & sure])
    if (learnt & ~sure).any():
        scores = network.logits(x)
        top = np.maximum.reduceat(scores, first[:-1])
        sure |= scores == top[of]
        network.train(x[learnt & sure], y[of][learnt & sure])
    part = aside if aside.any() else ~aside
    network.calibrate(x[part[of]], y[part], np.r_[0, np.cumsum(np.diff(first)[part])[:-1]], decided[part])
    return network


def rule_findings(candidates: DataFrame) -> DataFrame:
    """Labelled findings out of the candidates themselves, where a table has none.

    Base spans with varied characters are secrets, and so are other runs with a part
    of 20 or more varied characters in both cases with digits. Not secrets are runs
    that read as words, paths, versions, dates or repeats: with few digits, few
    distinct characters, or cut by many separators, if no part of them comes near
    a key. What neither rule covers has no label."""
    value = F.col("value")
    kinds = F.size(F.array_distinct(F.split(value, "")))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    parts = F.size(F.split(value, "[/_.=+-]+"))
    varied = lambda x, n, c, d: (F.length(x) >= n) & (F.size(F.array_distinct(F.split(x, ""))) >= c) & (F.length(F.regexp_replace(x, "[^0-9]", "")) >= d)
    key = F.exists(F.split(value, "[/_.=+-]+"), lambda x: varied(x, 20, 12, 3) & x.rlike("[A-Z].*[A-Z]") & x.rlike("[a-z].*[a-z]"))
    near = F.exists(F.split(value, "[/_.=+-]+"), lambda x: varied(x, 16, 9, 2))
    label = (F.when((F.col("kind") < len(BASE)) & (kinds >= 9) & (digits >= 2), 1)
             .when((F.col("kind") >= len(BASE)) & key, 1)
             .when((F.col("kind") >= len(BASE)) & ~near & ((kinds <= 7) | (parts >= 4) | (digits * 8 < F.length(value))), 0)
             .when((F.col("kind") < len(BASE)) & (kinds <= 4), 0))
    return candidates.select("before", "value", "after", label.alias("label")).where("label IS NOT NULL")


def plain_runs(docs: DataFrame, p: Params, text_col: str = "text") -> DataFrame:
    """Findings that are not secrets: pairs of neighbouring words as they stand in the texts, one for each document.

    They show the network what the prose around candidates looks like without one."""
    text = whole_text(text_col)
    at = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - 80, F.lit(1))).cast("int") + 1
    piece = F.substring(text, at, F.lit(p.context + 32 + p.after))
    return (docs.select(piece.alias("s")).where(F.length("s") == p.context + 32 + p.after)
            .where(~F.col("s").rlike(r"[A-Za-z0-9+/_.=-]*[0-9][A-Za-z0-9+/_.=-]{6,}|[=@]"))
            .select(F.left("s", F.lit(p.context)).alias("before"), F.substring("s", p.context + 1, 32).alias("value"),
                    F.right("s", F.lit(p.after)).alias("after"), F.lit(0).alias("label")))


def planted_findings(docs: DataFrame, p: Params, text_col: str = "text") -> DataFrame:
    """Findings put between words of the texts: one key of SHAPES, a secret, and one slug or path that is none for each document.

    A key's random part is a digest of the text in base 64, without its signs. The
    slug joins the words around the place by one sign, with a number of one to four
    digits; both stand between the same words."""
    text = whole_text(text_col)
    at = (F.pmod(F.xxhash64(text, F.lit(1)), F.greatest(F.length(text) - 120, F.lit(1))) + 1).cast("int")
    around = F.regexp_extract_all(F.substring(text, at, F.lit(120)), F.lit(r"(?<=\s)[A-Za-z]+(?=\s)"), F.lit(0))
    code = F.translate(F.concat(*[F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), text), 256))) for salt in ("one ", "two ")]), "+/=", "")
    of = lambda choices, salt: F.get(F.array(*choices), F.pmod(F.xxhash64(text, F.lit(salt)), F.lit(len(choices))).cast("int"))
    shape = of([F.struct(F.lit(a).alias("head"), F.lit(n).alias("n")) for a, n in SHAPES], 2)
    put = docs.select(around.alias("w"), code.alias("code"), shape.alias("shape"), of([F.lit(c) for c in "-_/."], 3).alias("sign"),
                      F.pmod(F.xxhash64(text, F.lit(4)), F.pow(F.lit(10), of([F.lit(k) for k in (1, 2, 3, 4)], 5)).cast("long")).alias("number"),
                      of([F.lit(" "), F.lit(": "), F.lit("=")], 6).alias("by")).where(F.size("w") >= 10)
    words = lambda a, n: F.slice("w", a, n)
    before = F.right(F.concat(F.concat_ws(" ", words(1, 4)), F.col("by")), F.lit(p.context))
    after = F.left(F.concat(F.lit(" "), F.concat_ws(" ", words(9, 2))), F.lit(p.after))
    key = F.concat("shape.head", F.substring("code", F.lit(1), F.col("shape.n")))
    slug = F.array_join(F.concat(words(5, 2), F.array(F.col("number").cast("string")), words(7, 2)), "\x01")
    row = lambda value, label: F.struct(before.alias("before"), value.alias("value"), after.alias("after"), F.lit(label).alias("label"))
    return put.select(F.inline(F.array(row(key, 1), row(F.replace(slug, F.lit("\x01"), F.col("sign")), 0)))).where(F.length("value") >= 16)


def made_findings(docs: DataFrame, p: Params, text_col: str = "text") -> DataFrame:
    """Labelled findings of a table that has none, with their ``origin``."""
    each = docs.select(find_candidates(whole_text(text_col), p).alias("_spans")).where(F.size("_spans") > 0).select(F.inline("_spans"))
    parts = {"rules": rule_findings(each), "plain": plain_runs(docs, p, text_col), "planted": planted_findings(docs, p, text_col)}
    rows = [df.withColumn("origin", F.lit(name)) for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, p: Params | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the text column, with ``secrets``: an array, by start and kind, of
    (start, kind, end, p), where p is the network's probability (null without a network)."""
    p = p or Params()
    rest = [c for c in docs.columns if c not in {text_col, "secrets"}]
    with scratch(docs.sparkSession):
        network = fit_network(findings if findings is not None else written(made_findings(docs, p, text_col), "findings"), p)
    shipped = docs.sparkSession.sparkContext.broadcast(network)  # some thousand numbers

    @F.pandas_udf("array<struct<start:int,kind:int,end:int,p:double>>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shipped.value
        for batch in batches:
            each = [all_spans(t) for t in batch]
            q = iter([None] * sum(map(len, each)) if net is None else net.best([seen(t, a, b, p) for t, spans in zip(batch, each, strict=True) for a, _, b in spans]).tolist())
            scored = [[{"start": a, "kind": k, "end": b, "p": next(q)} for a, k, b in spans] for spans in each]
            yield pd.Series([[s for s in spans if s["kind"] < len(BASE) or (net is not None and s["p"] >= net.threshold)] for spans in scored])

    return docs.select(*rest, judged(whole_text(text_col)).alias("secrets"))


def digest_columns(found: DataFrame, keys: list[str]) -> DataFrame:
    """The counts and digests of a result of ``find_secrets``."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select(*keys, *counts, F.sha2(told(F.filter("secrets", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
