import random
import math

import pytest

from revsift.operators.metrics import metrics_from_counts, metrics_long, screening_metrics, threshold_label, \
    threshold_sweep

# Published count quadruples (TP, FP, TN, FN) with a few published values (4 decimals / 6 decimals).
PUBLISHED = [
    ((587, 0, 0, 187), {"recall": 0.7584, "precision": 1.0, "balanced_accuracy": 0.3792, "f1": 0.8626,
                        "work_saved": 0.2416, "recall_ci_low": 0.728241, "recall_ci_high": 0.788555,
                        "balanced_accuracy_ci_low": 0.345017, "precision_ac_ci_low": 0.992159,
                        "balanced_accuracy_ac_ci_low": 0.363493}),
    ((67, 178, 319, 12), {"recall": 0.8481, "precision": 0.2735, "specificity": 0.6419, "accuracy": 0.6701,
                          "balanced_accuracy": 0.7450, "f1": 0.4136, "work_saved": 0.5747, "wss": 0.4228,
                          "precision_ci_low": 0.217654, "recall_ac_ci_low": 0.751441,
                          "balanced_accuracy_ac_ci_high": 0.797629}),
    ((471, 1676, 33778, 187), {"recall": 0.7158, "precision": 0.2194, "specificity": 0.9527, "wss": 0.6564,
                               "accuracy_ci_low": 0.946129, "balanced_accuracy_ci_high": 0.838102}),
    ((71, 0, 0, 85), {"recall": 0.4551, "f1": 0.6256, "recall_ac_ci_low": 0.378990,
                      "bal_dummy": None}),
]


def _python_reference(tp, fp, tn, fn):
    """Independent plain-Python evaluation of the published formulas."""
    total = tp + fp + tn + fn
    rec = tp / (tp + fn) if tp + fn else 0.0
    prec = tp / (tp + fp) if tp + fp else 0.0
    spec = tn / (tn + fp) if tn + fp else 0.0
    acc = (tp + tn) / total if total else 0.0
    bal = (rec + spec) / 2 if rec + spec else 0.0
    f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
    ws = (tn + fn) / total if total else 0.0

    def wald(p, n):
        if n == 0:
            return 0.0, 0.0
        se = math.sqrt(p * (1 - p) / n)
        return max(0.0, p - 1.96 * se), min(1.0, p + 1.96 * se)

    def ac(x, n):
        if n == 0:
            return 0.0, 0.0
        nt = n + 1.96 ** 2
        pt = (x + 1.96 ** 2 / 2) / nt
        se = math.sqrt(pt * (1 - pt) / nt)
        return max(0.0, pt - 1.96 * se), min(1.0, pt + 1.96 * se)

    out = dict(recall=rec, precision=prec, specificity=spec, accuracy=acc, balanced_accuracy=bal, f1=f1,
               work_saved=ws, wss=ws - (1 - rec))
    for name, (lo, hi) in [("recall_ci", wald(rec, tp + fn)), ("precision_ci", wald(prec, tp + fp)),
                           ("specificity_ci", wald(spec, tn + fp)), ("accuracy_ci", wald(acc, total)),
                           ("balanced_accuracy_ci", wald(bal, total)), ("recall_ac_ci", ac(tp, tp + fn)),
                           ("precision_ac_ci", ac(tp, tp + fp)), ("specificity_ac_ci", ac(tn, tn + fp)),
                           ("accuracy_ac_ci", ac(tp + tn, total))]:
        out[name + "_low"], out[name + "_high"] = lo, hi
    out["balanced_accuracy_ac_ci_low"] = (out["recall_ac_ci_low"] + out["specificity_ac_ci_low"]) / 2
    out["balanced_accuracy_ac_ci_high"] = (out["recall_ac_ci_high"] + out["specificity_ac_ci_high"]) / 2
    return out


@pytest.mark.parametrize("counts,published", PUBLISHED + [((0, 0, 0, 0), {})])
def test_metrics_match_published_and_python(spark, counts, published):
    df = spark.createDataFrame([counts], "tp bigint, fp bigint, tn bigint, fn bigint")
    row = metrics_from_counts(df).first().asDict()
    ref = _python_reference(*counts)
    for k, v in ref.items():
        assert row[k] == v, (k, row[k], v)          # bit-identical to plain Python
    for k, v in published.items():
        if v is None:
            continue
        places = 4 if k in ref and not k.endswith(("_low", "_high")) else 6
        assert round(row[k], places) == pytest.approx(v, abs=10 ** -places), k


def test_zero_counts(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "tp bigint, fp bigint, tn bigint, fn bigint")
    row = metrics_from_counts(df).first().asDict()
    assert row["wss"] == -1.0
    assert all(row[k] == 0.0 for k in row if k.endswith(("_low", "_high")))


def test_screening_metrics_from_labels(spark):
    rows = [(1, 1)] * 5 + [(0, 1)] * 2 + [(0, 0)] * 7 + [(1, 0)] * 3
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    r = screening_metrics(df).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (5, 2, 7, 3)
    long = metrics_long(screening_metrics(df)).orderBy("ord").collect()
    assert [x.metric for x in long[:5]] == ["tp", "fp", "tn", "fn", "recall"]
    assert len(long) == 22


def test_threshold_label_pandas_semantics(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (1.0,), (None,), (float("nan"),)], "p double")
    assert [r.l for r in df.select(threshold_label("p", 0.5).alias("l")).collect()] == [1, 0, 1, 0, 0]


def test_threshold_sweep_equals_single_thresholds(spark):
    rows = [(i / 20.0, i % 3 == 0 and 1 or 0) for i in range(21)] + [(None, 1), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "probability double, y_true int")
    sweep = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in threshold_sweep(df, [0.25, 0.5, 0.9]).collect()}
    for t in (0.25, 0.5, 0.9):
        single = screening_metrics(df.withColumn("y_pred", threshold_label("probability", t))).first()
        assert sweep[t] == (single.tp, single.fp, single.tn, single.fn)


def test_metrics_bit_identical_on_random_counts(spark):
    import random
    rnd = random.Random(23)
    quads = [tuple(rnd.choice([0, 0, 1, 2, rnd.randint(0, 50), rnd.randint(0, 10**6)]) for _ in range(4))
             for _ in range(300)]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(quads)], "i int, tp bigint, fp bigint, tn bigint, fn bigint")
    rows = {r.i: r.asDict() for r in metrics_from_counts(df).collect()}
    for i, q in enumerate(quads):
        ref = _python_reference(*q)
        for k, v in ref.items():
            assert rows[i][k] == v, (q, k, rows[i][k], v)


def read_until(rows, target):
    """Rows read, by score, until the target recall is reached; equal scores are read together, those without one last."""
    rows = [(None if p is None or p != p else p, y) for p, y in rows]
    need, total = target * sum(y or 0 for _, y in rows), 0
    for score in sorted({p for p, _ in rows}, key=lambda p: (p is None, -(p or 0))):
        total += sum(p == score for p, _ in rows)
        if sum(y or 0 for p, y in rows if p is not None and (score is None or p >= score) or p == score) >= need:
            return total
    return None


def test_wss_at_recall_is_exact(spark):
    from revsift.operators.metrics import wss_at_recall

    frame = lambda rows: spark.createDataFrame(rows, "probability double, y_true int")
    near = [(0.90004, 1), (0.90003, 0), (0.90002, 0), (0.90001, 0)]
    row = wss_at_recall(frame(near), [0.95]).first()
    assert row.read == 1 and row.wss == pytest.approx(0.70)
    rnd = random.Random(4)
    rows = [(rnd.choice([0.5 + rnd.randrange(60) * 1e-6, rnd.random(), None, float("nan"), 1e-300, -2.5]), rnd.choice([0, 0, 0, 1, None])) for _ in range(700)]
    for block in (1, 7, 1 << 20):
        got = {r.target: r.read for r in wss_at_recall(frame(rows), [0.5, 0.9, 0.95, 1.0, 0.9], block=block).collect()}
        assert got == {t: read_until(rows, t) for t in (0.5, 0.9, 0.95, 1.0)}
    assert wss_at_recall(frame([]), [0.9]).count() == 0
