"""Confusion counts, the full screening metric bundle, thresholds.

All metrics come from one aggregate of four conditional counts (partial
aggregation happens map-side, so the shuffle carries one row per group and per
task, whatever the skew of the grouping keys), followed by a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .. import defaults as D
from ..functions.text import col_of
from ..session import materialise
from .ordering import row_index

# Metric columns of the bundle, in report order.
POINT_METRICS = ["recall", "precision", "specificity", "accuracy", "balanced_accuracy",
                 "f1", "work_saved", "wss"]
INTERVALS = ["recall_ci", "precision_ci", "specificity_ci", "accuracy_ci",
             "balanced_accuracy_ci", "recall_ac_ci", "precision_ac_ci",
             "specificity_ac_ci", "accuracy_ac_ci", "balanced_accuracy_ac_ci"]


def threshold_label(p, threshold: float = D.THRESHOLD) -> Column:
    """1 when p >= threshold, else 0. NULL and NaN give 0 (pandas semantics)."""
    pc = col_of(p)
    return F.when(pc.isNotNull() & ~F.isnan(pc) & (pc >= F.lit(float(threshold))), F.lit(1)).otherwise(F.lit(0))


def confusion_counts(df: DataFrame, y_true="y_true", y_pred="y_pred",
                     group_by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, TN, FN as BIGINT, optionally per group."""
    t, p = col_of(y_true), col_of(y_pred)
    aggs = [
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
    ]
    g = df.groupBy(*group_by) if group_by else df.groupBy()
    return g.agg(*aggs)


def metrics_from_counts(counts: DataFrame, extra_fn: Column | None = None) -> DataFrame:
    """Add every metric of the bundle to a table holding tp, fp, tn, fn.

    ``extra_fn`` adds to FN before the metrics are taken (unmatched golden rows
    counted as missed, without materialising padding rows). All metrics are
    one projection (a single analysis pass; Catalyst would inline stacked
    projections anyway).
    """
    c = counts
    if extra_fn is not None:
        c = c.withColumn("fn", F.col("fn") + extra_fn)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    rec = S.recall(tp, fn)
    prec = S.precision(tp, fp)
    spec = S.specificity(tn, fp)
    acc = S.accuracy(tp, fp, tn, fn)
    bal = S.balanced_accuracy(rec, spec)
    f1 = S.f1(prec, rec)
    ws = S.work_saved(tn, fn, total)
    cols = [total.alias("total"), rec.alias("recall"), prec.alias("precision"), spec.alias("specificity"),
            acc.alias("accuracy"), bal.alias("balanced_accuracy"), f1.alias("f1"), ws.alias("work_saved"),
            S.wss(rec, ws).alias("wss")]

    def add(name, pair):
        cols.extend([pair[0].alias(name + "_low"), pair[1].alias(name + "_high")])

    add("recall_ci", S.wald_interval(rec, tp + fn))
    add("precision_ci", S.wald_interval(prec, tp + fp))
    add("specificity_ci", S.wald_interval(spec, tn + fp))
    add("accuracy_ci", S.wald_interval(acc, total))
    add("balanced_accuracy_ci", S.wald_interval(bal, total))
    rec_ac = S.agresti_coull_interval(tp, tp + fn)
    spec_ac = S.agresti_coull_interval(tn, tn + fp)
    add("recall_ac_ci", rec_ac)
    add("precision_ac_ci", S.agresti_coull_interval(tp, tp + fp))
    add("specificity_ac_ci", spec_ac)
    add("accuracy_ac_ci", S.agresti_coull_interval(tp + tn, total))
    add("balanced_accuracy_ac_ci", ((rec_ac[0] + spec_ac[0]) / F.lit(2.0), (rec_ac[1] + spec_ac[1]) / F.lit(2.0)))
    return c.select("*", *cols)


def screening_metrics(df: DataFrame, y_true="y_true", y_pred="y_pred",
                      group_by: Sequence[str] = ()) -> DataFrame:
    """Counts plus the full metric bundle, one row per group."""
    return metrics_from_counts(confusion_counts(df, y_true, y_pred, group_by))


def metrics_long(metrics: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Unpivot a metric bundle to ``(ord, metric, value, ci_low, ci_high)`` rows.

    Counts come first, then the point metrics, then the intervals, as in the
    published report files."""
    entries = []
    for i, name in enumerate(["tp", "fp", "tn", "fn"]):
        entries.append((i, name, F.col(name).cast("double"), F.lit(None).cast("double"),
                        F.lit(None).cast("double")))
    for j, name in enumerate(POINT_METRICS):
        entries.append((4 + j, name, F.col(name), F.lit(None).cast("double"), F.lit(None).cast("double")))
    for k, name in enumerate(INTERVALS):
        entries.append((12 + k, name, F.lit(None).cast("double"), F.col(name + "_low"), F.col(name + "_high")))
    arr = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("metric"), v.alias("value"),
                             lo.alias("ci_low"), hi.alias("ci_high")) for o, n, v, lo, hi in entries])
    return metrics.select(*group_by, F.inline(arr))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], prob="probability",
                    y_true="y_true", group_by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and metrics for several thresholds in one pass.

    Each row is mapped to the number of thresholds its score reaches, so that one
    aggregation leaves at most (thresholds + 1) x 2 counts for each group, however
    many different scores there are. Those few rows are then spread over the
    thresholds and summed.
    """
    p, ts = col_of(prob), sorted({float(t) for t in thresholds})
    scored_ = p.isNotNull() & ~F.isnan(p)
    reached = sum((F.when(scored_ & (p >= F.lit(t)), 1).otherwise(0) for t in ts), F.lit(0))
    pre = scored.groupBy(*group_by, reached.alias("_b"), col_of(y_true).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i).alias("_i")) for i, t in enumerate(ts)])
    fanned = pre.select(*group_by, "_b", "_t", "_n", F.inline(each))
    pred, t = F.when(F.col("_b") > F.col("_i"), 1).otherwise(0), F.col("_t")
    sum_if = lambda truth, said: F.sum(F.when((t == truth) & (pred == said), F.col("_n")).otherwise(0)).cast("bigint")
    counts = fanned.groupBy(*group_by, "threshold").agg(sum_if(1, 1).alias("tp"), sum_if(0, 1).alias("fp"), sum_if(0, 0).alias("tn"), sum_if(1, 0).alias("fn"))
    return metrics_from_counts(counts)


def wss_at_recall(paired: DataFrame, recalls: Sequence[float], probability: str = "probability", y_true: str = "y_true",
                  block: int = 1 << 20) -> DataFrame:
    """Work saved over sampling at target recalls: rows are read in the order of their score until the recall is reached.

    Rows are counted by their exact score; those of one score are read together, those
    without one last. The counts are sorted over the cluster and cut into blocks of
    ``block`` scores. The sums of the blocks, one row each, tell in which block each
    recall is reached, and only the rows of those blocks are summed one by one."""
    p = F.col(probability).cast("double")
    score = F.when(p.isNotNull() & ~F.isnan(p), p)
    by = materialise(paired.groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(y_true).cast("long")), F.lit(0)).alias("pos")), "score-counts")
    placed = row_index(by, [F.desc_nulls_last("score")], "_i").withColumn("_blk", F.floor(F.col("_i") / block))
    earlier = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_blk").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    starts = sums.select("_blk", "n", "pos", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "pos")])
    totals = by.agg(F.sum("n").alias("total"), F.sum("pos").alias("relevant"))
    reached = lambda pos: pos >= F.col("target") * F.col("relevant")
    targets = F.explode(F.array(*[F.lit(float(r)) for r in dict.fromkeys(recalls)]))
    cut = (starts.join(totals, F.lit(True)).withColumn("target", targets).where(reached(F.col("_pos") + F.col("pos")))
           .groupBy("target", "total", "relevant").agg(F.min(F.struct("_blk", "_n", "_pos")).alias("b")).select("target", "total", "relevant", "b.*"))
    cut = materialise(cut, "recall-blocks")  # one row a target
    upto = Window.partitionBy("target").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(F.broadcast(cut), "_blk").select("target", "total", "relevant", (F.col("_n") + F.sum("n").over(upto)).alias("read"), (F.col("_pos") + F.sum("pos").over(upto)).alias("found"))
    least = rows.where(reached(F.col("found"))).groupBy("target", "total", "relevant").agg(F.min("read").alias("read"))
    return least.select("target", "read", "total", ((F.col("total") - F.col("read")) / F.col("total") - (F.lit(1.0) - F.col("target"))).alias("wss"))
