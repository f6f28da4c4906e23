"""Metric formulas as Column expressions over integer confusion counts.

Operation order follows the published definitions so that doubles agree bit for
bit with a plain-Python evaluation (and with the DuckDB oracle SQL).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the normal quantile used for every 95 % interval.
Z95 = 1.96


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def safe_ratio(num, den) -> Column:
    """num / den, or 0.0 when den is not positive."""
    return F.when(_d(den) > 0, _d(num) / _d(den)).otherwise(F.lit(0.0))


def recall(tp, fn) -> Column:
    return safe_ratio(tp, _d(tp) + _d(fn))


def precision(tp, fp) -> Column:
    return safe_ratio(tp, _d(tp) + _d(fp))


def specificity(tn, fp) -> Column:
    return safe_ratio(tn, _d(tn) + _d(fp))


def accuracy(tp, fp, tn, fn) -> Column:
    total = _d(tp) + _d(fp) + _d(tn) + _d(fn)
    return safe_ratio(_d(tp) + _d(tn), total)


def balanced_accuracy(rec: Column, spec: Column) -> Column:
    s = rec + spec
    return F.when(s > 0, s / F.lit(2.0)).otherwise(F.lit(0.0))


def f1(prec: Column, rec: Column) -> Column:
    s = prec + rec
    return F.when(s > 0, F.lit(2.0) * prec * rec / s).otherwise(F.lit(0.0))


def work_saved(tn, fn, total) -> Column:
    return F.when(_d(total) > 0, (_d(tn) + _d(fn)) / _d(total)).otherwise(F.lit(0.0))


def wss(rec: Column, ws: Column) -> Column:
    """Work saved minus (1 - recall), at the observed recall."""
    return ws - (F.lit(1.0) - rec)


def wald_interval(p: Column, n, z: float = Z95) -> tuple[Column, Column]:
    """Wald interval for a proportion, clamped to [0, 1]; n = 0 gives (0, 0)."""
    nd = _d(n)
    se = F.sqrt(p * (F.lit(1.0) - p) / nd)
    lo = F.when(nd == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), p - F.lit(z) * se))
    hi = F.when(nd == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), p + F.lit(z) * se))
    return lo, hi


def agresti_coull_interval(x, n, z: float = Z95) -> tuple[Column, Column]:
    """Agresti–Coull interval for x successes in n trials; n = 0 gives (0, 0)."""
    nd = _d(n)
    z2 = z * z
    n_t = nd + F.lit(z2)
    p_t = (_d(x) + F.lit(z2 / 2)) / n_t
    se = F.sqrt(p_t * (F.lit(1.0) - p_t) / n_t)
    lo = F.when(nd == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), p_t - F.lit(z) * se))
    hi = F.when(nd == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), p_t + F.lit(z) * se))
    return lo, hi
