"""Expectation-maximisation over votes (Dawid and Skene with two classes).

Each voter says 1, -1 or 0 (abstains). Rows are first counted by vote pattern,
so a fit reads at most 3^voters rows, however many rows voted. Every step is
one DataFrame aggregation over the patterns, and the driver sees only the few
sums it returns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import written

SMOOTH = 2.0  # pseudo-votes for each cell, so that no estimate reaches 0 or 1


@dataclass(frozen=True)
class Votes:
    """What the fit learned: the share of class 1 and, per voter, P(vote = 1 | class)."""

    prior: float
    rates: dict[str, tuple[float, float]]  # voter: (given class 1, given class 0)

    def log_odds(self, of: str = "") -> str:
        """SQL: log odds of class 1 from the vote columns; an abstention adds nothing. ``of``: what they are fields of."""
        out = [repr(math.log(self.prior / (1 - self.prior)))]
        for voter, (one, zero) in self.rates.items():
            yes, no = math.log(one / zero), math.log((1 - one) / (1 - zero))
            out.append(f"CASE {of}{voter} WHEN 1 THEN {yes!r} WHEN -1 THEN {no!r} ELSE 0 END")
        return "double(" + " + ".join(out) + ")"

    def posterior(self, of: str = "") -> str:
        """SQL: the probability of class 1."""
        return f"(1 / (1 + exp(-({self.log_odds(of)}))))"


def fit_votes(rows: DataFrame, voters: list[str], prior: float = 0.8, accuracy: float = 0.8, steps: int = 12, floor: float = 0.0) -> Votes:
    """Estimate each voter's reliability from agreement alone.

    An empty table returns the starting values. The start says that voters are
    right with ``accuracy``; it decides which of the two classes is called 1.
    ``floor``: a voter that votes is taken to be right at least so often in either
    class, so that it is never estimated to say nothing, or the opposite."""
    patterns = written(rows.groupBy(*voters).agg(F.count(F.lit(1)).cast("double").alias("n")), "vote-patterns")
    given = {"one": "p", "zero": "1 - p"}
    sums = ["sum(n) AS n", "sum(p * n) AS one"] + [
        f"sum(CASE WHEN {v} = {said} THEN ({q}) * n ELSE 0 END) AS `{v} {c} {said}`" for v in voters for said in (1, -1) for c, q in given.items()]
    model = Votes(prior, {v: (accuracy, 1 - accuracy) for v in voters})
    for _ in range(steps):
        s = patterns.withColumn("p", F.expr(model.posterior())).selectExpr(*sums).first()
        if not s["n"]:
            return model
        rates = {}
        for v in voters:
            start = dict(zip(("one", "zero"), (accuracy, 1 - accuracy), strict=True))
            one, zero = (
                (s[f"{v} {c} 1"] + 2 * SMOOTH * start[c]) / (s[f"{v} {c} 1"] + s[f"{v} {c} -1"] + 2 * SMOOTH)
                for c in ("one", "zero"))
            rates[v] = max(one, floor), min(zero, 1 - floor)
        new = Votes((s["one"] + SMOOTH) / (s["n"] + 2 * SMOOTH), rates)
        moved = max([abs(new.prior - model.prior), *(abs(a - b) for v in voters for a, b in zip(new.rates[v], model.rates[v], strict=True))])
        model = new
        if moved < 1e-4:
            break
    return model
