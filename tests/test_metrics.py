import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.functions.distributions import student_t_p, t_tail
from cohortline.operators import metrics as M


def test_smape_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "t double, p double")
    assert df.agg(M.smape(F.col("t"), F.col("p"))).first()[0] == 0.5


def test_auc_one_class_and_all_ties(spark, both_forms):
    df = spark.createDataFrame([("one", 1, 0.3), ("one", 1, 0.9), ("tie", 0, 0.5), ("tie", 1, 0.5), ("tie", 1, 0.5)], "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in M.roc_auc(df, "y", "s", ["g"]).collect()}
    assert got == {"one": None, "tie": 0.5}


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


def test_auc_and_ap_brute_force(spark, both_forms):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 2000), np.round(rng.random(2000), 3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(brute_auc(y, s))
    total, ap, prev = y.sum(), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = (y[hit] == 1).sum() / total
        ap += (recall - prev) * (y[hit] == 1).mean()
        prev = recall
    assert M.average_precision(df, "y", "s").first()["auprc"] == pytest.approx(ap)
    curve = M.pr_curve(df, "y", "s")
    assert curve.filter("tp + fp + fn + tn <> 2000").count() == 0


def test_kappa_matches_definition(spark, both_forms):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 500), rng.integers(0, 6, 500)
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(a, b)], "a int, b int")
    observed = np.abs(a - b).mean()
    expected = np.abs(a[:, None] - b[None, :]).mean()
    assert M.kappa_linear(df, "a", "b").first()["kappa"] == pytest.approx(1 - observed / expected)


def test_direction_and_negation():
    assert M.get_metric("smape").better == "min"
    neg = M.get_metric("neg_mse")
    assert neg.better == "max" and neg.sign == -1.0
    with pytest.raises(KeyError):
        M.get_metric("nothing")
    assert M.default_metric("regression") == "mse" and M.default_metric("binary") == "roc_auc"


def test_custom_metric_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "t double, p double")
    got = M.evaluate(df, "t", "p", ["mae", ("worst", M.Metric("min", lambda t, p: F.max(F.abs(t - p))))]).first()
    assert got["mae"] == 1.5 and got["worst"] == 2.0 and got["n"] == 2


def test_negated_metric_value(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "t double, p double")
    row = M.evaluate(df, "t", "p", ["neg_mse", "mse", "spearman"]).first()
    assert row["neg_mse"] == -row["mse"] and row["spearman"] == pytest.approx(1.0)


def test_t_probabilities(spark):
    # Table values: P(|T| > 2.228) = 0.05 at 10 df, P(|T| > 1.96) -> 0.05 for many df.
    assert t_tail(np.array([2.228139]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-6)
    assert t_tail(np.array([1.959964]), np.array([1e7]))[0] == pytest.approx(0.05, abs=1e-5)
    assert t_tail(np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.5)
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (3.0, 0.0)], "t double, d double")
    assert [r[0] for r in df.select(student_t_p("t", "d")).collect()] == [1.0, None, None]


def test_confusion_wide_and_multilabel(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "a int, b int")
    wide = {r["a"]: (r["0"], r["1"]) for r in M.confusion_wide(df, "a", "b", [0, 1]).collect()}
    assert wide == {0: (1, 1), 1: (0, 1)}
    lists = spark.createDataFrame([([1.0, 0.0], [0.9, 0.1])], "t array<double>, p array<double>")
    assert lists.agg(M.threshold_accuracy(F.col("t"), F.col("p"))).first()[0] == 1.0
    assert lists.agg(M.fbeta_samples(F.col("t"), F.col("p"))).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_multiclass_auc_averages(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 3, 600), rng.random((600, 3))
    df = spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(y, s)], "y int, a double, b double, c double")
    got = M.multiclass_auc(df, "y", {0: "a", 1: "b", 2: "c"}).first()
    each = np.array([brute_auc((y == c).astype(int), s[:, c]) for c in range(3)])
    n = np.bincount(y)
    assert got["auc_macro"] == pytest.approx(each.mean()) and got["auc_weighted"] == pytest.approx((each * n).sum() / n.sum())
    assert got["auc_micro"] == pytest.approx(brute_auc(np.eye(3)[y].ravel(), s.ravel()))


def test_custom_metrics_state_their_direction(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "t double, p double")
    worst = M.Metric("min", lambda t, p: F.max(F.abs(t - p)))
    assert M.evaluate(df, "t", "p", [("worst", worst), "sum"]).first().asDict() == {"n": 2, "worst": 1.0, "sum": 5.0}
    with pytest.raises(TypeError):
        M.evaluate(df, "t", "p", [("worst", worst.expr)])
    assert M.get_metric(M.default_metric("multiclass")).better == "max"
    assert M.get_metric("false_negatives").better == "min"
