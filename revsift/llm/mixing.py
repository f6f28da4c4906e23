"""Mixing sources to target weights by raking (operator 8, DataFrame functions only).

Documents are counted into cells of source, language and topic. Iterative
proportional fitting scales the cells' weights until the weighted tokens of
each margin have their target shares. A document is then sampled with its
cell's calibrated probability, and a ``weight`` makes up for what a probability
of 1 cannot give, so that weight times tokens of the sample meets the targets in
expectation.

Only cells (at most sources x languages x topics) and margins are joined and
aggregated in the rounds; what reaches the driver is one row of sums a round.

Defined cases: null margins form a value of their own; a null or empty text has
one token, so that it can be sampled; rows with the same id, source and text
are sampled alike; other columns pass through, but for those named like the
results. Target values that no document has are left out, values without a
target keep their share of the tokens. Targets that clash, as no weights can meet
them all, give the weights of the last round and a warning that names the gap.
An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import whole_text, written

MARGINS = ["source", "lang", "topic"]


@dataclass(frozen=True)
class Params:
    keep: float = 0.5  # share of all tokens that the sample is to hold
    tempers: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.8})  # default target: shares to this power
    rounds: int = 30
    tolerance: float = 1e-4
    seed: int = 17


def n_tokens(text: Column) -> Column:
    """The words of a text; one without words counts as one."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def form_topic(text: Column) -> Column:
    """A topic for tables that have none: the form of the text."""
    tokens = n_tokens(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return (F.when(tokens < 60, "snippet").when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("icens")) | F.contains(text, F.lit("icenc")), "licensed")
            .when(tokens / lines < 15, "list").when(tokens > 1000, "long").otherwise("prose"))


def uniform(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / float(1 << 52)


def _value(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def tempered_targets(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """Shares in proportion to a power of the tokens: under 1, small values gain."""
    raised = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("share"))
    all_ = raised.agg(F.sum("share")).first()[0] or 1.0
    return raised.withColumn("share", F.col("share") / all_)


def given_targets(cells: DataFrame, margin: str, targets: DataFrame, total: float) -> DataFrame:
    """``targets(value, share)`` for the values that occur; others keep theirs; all scaled to 1."""
    own = cells.groupBy(margin).agg((F.sum("tokens") / total).alias("own"))
    both = own.join(targets.select(F.coalesce(F.concat(F.lit("="), F.col("value").cast("string")), F.lit("null")).alias(margin), "share"), margin, "left")
    both = both.select(margin, F.coalesce("share", "own").alias("share"))
    all_ = both.agg(F.sum("share")).first()[0] or 1.0
    return both.withColumn("share", F.col("share") / all_)


def rake(cells: DataFrame, targets: dict[str, DataFrame], p: Params) -> DataFrame:
    """``cells`` with ``w``, so that the sums of w * tokens meet the target shares of every margin.

    Warns if some margin's last factor still was further from 1 than ``tolerance``."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells, off = cells.withColumn("w", F.lit(1.0)), None
    for _ in range(p.rounds):
        for k, (margin, target) in enumerate(targets.items()):
            sums = cells.groupBy(margin).agg(F.sum(F.col("w") * F.col("tokens")).alias("have")).join(target, margin)
            factors = sums.select(margin, (F.col("share") * total / F.col("have")).alias("factor"))
            cells = cells.join(factors, margin).withColumn("w", F.col("w") * F.col("factor")).withColumn(
                "off", F.abs(F.col("factor") - 1) if k == 0 else F.greatest("off", F.abs(F.col("factor") - 1))).drop("factor")
        cells = written(cells, "cells")
        off = cells.agg(F.max("off")).first()[0]
        cells = cells.drop("off")
        if off is None or off < p.tolerance:
            break
    if off is not None and off >= p.tolerance:
        warnings.warn(f"after {p.rounds} rounds a margin is off its target by a factor of {1 + off:.6g}", stacklevel=2)
    return cells


def calibrated(cells: DataFrame, p: Params) -> DataFrame:
    """``probability`` = min(1, c * w), with c such that the expected sample holds the share ``keep`` of the tokens."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    c = p.keep
    for _ in range(20):  # each step can only add cells that are kept whole
        whole = F.col("w") * c >= 1
        full, rest = cells.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~whole, F.col("w") * F.col("tokens"))), F.lit(0.0))).first()
        new = (p.keep * total - full) / rest if rest else c
        if new <= c * (1 + 1e-9):
            break
        c = new
    return (cells.withColumn("probability", F.least(F.lit(1.0), F.col("w") * c))
            .withColumn("weight", F.greatest(F.lit(1.0), F.col("w") * c)))


def mixture(docs: DataFrame, p: Params | None = None, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text",
            topic: Column | None = None) -> DataFrame:
    """``docs`` with ``topic``, ``tokens``, ``probability``, ``weight`` and ``sampled``.

    ``targets``: (value, share) tables by margin; a margin without one gets tempered shares.
    ``topic``: an expression; by default the column of that name, or else the form of the text."""
    p = p or Params()
    text = whole_text(text_col)
    topic = topic if topic is not None else F.col("topic") if "topic" in docs.columns else form_topic(text)
    rest = [c for c in docs.columns if c not in {"topic", "tokens", "probability", "weight", "sampled"}]
    rows = docs.select(*rest, topic.alias("topic"), n_tokens(text).alias("tokens"))
    keyed = rows.withColumns({f"_{m}": _value(m) for m in MARGINS})
    cells = written(keyed.groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS]).agg(F.sum("tokens").alias("tokens")), "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    aims = {m: written(given_targets(cells, m, targets[m], total) if targets and m in targets else tempered_targets(cells, m, p.tempers[m]), "targets") for m in MARGINS}
    fitted = written(calibrated(rake(cells, aims, p), p), "mix").select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "probability", "weight")
    chance = uniform(F.col(id_col), F.col("_source"), text, seed=p.seed)
    return (keyed.withColumn("_u", chance).join(fitted, [f"_{m}" for m in MARGINS])
            .withColumn("sampled", F.col("_u") < F.col("probability"))
            .select(*rest, "topic", "tokens", "probability", "weight", "sampled"))


def sample_mixture(docs: DataFrame, p: Params | None = None, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows of ``docs`` with ``tokens``, ``probability`` and ``weight``."""
    return mixture(docs, p, targets, id_col, text_col).where("sampled").drop("sampled")
