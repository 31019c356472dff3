"""A learning curve from sums of products next to single fits."""

import numpy as np
import pytest

from cohortline.operators import models as L


def test_learning_curve_from_sums_equals_single_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    rows = [(i, float(x[i, 0]), None if i % 9 == 0 else float(x[i, 1]), float(x[i, 0] + rng.normal()) if i % 50 else None, i % 3 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, fold int")
    args = (df, "fold", [1, 2, 3], "id", "y", L.preparation(["a", "b"]), "LinearRegression", "rmse")
    by_size = {r["train_share"]: r for r in L.learning_curve(*args, sizes=(0.3, 1.0)).collect()}
    for r in L.learning_curve(*args, sizes=(0.3, 1.0), from_sums=["a", "b"]).collect():
        assert r["score_mean"] == pytest.approx(by_size[r["train_share"]]["score_mean"], rel=1e-9)
        assert r["score_sd"] == pytest.approx(by_size[r["train_share"]]["score_sd"], rel=1e-6)
        assert r["folds"] == 3
    with pytest.raises(ValueError):
        L.learning_curve(*args[:-1], "mae", from_sums=["a", "b"])
