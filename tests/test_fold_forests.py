"""Forests of all folds grown together: splits by brute force, Spark's forest, and no dependence on partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.catalog import QUERIES
from cohortline.operators import forests, models


def _rows(spark, n=240):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 12, n), rng.normal(size=n), rng.integers(0, 3, n)
    y = a + 3.0 * (b > 0.3) + rng.normal(size=n)
    rows = [(i, float(y[i]) if i % 31 else None, float(a[i]), None if i % 7 == 0 else float(b[i]), float(c[i]), int(i % 3 + 1)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, a double, b double, c double, fold int")


def _gains(x, y, w, cuts, depth, gain):
    """Adds the decreases of the squared error of the best splits to ``gain``, by feature."""
    if depth == 0 or not w.sum():
        return
    best = (1e-9, None)
    for i, points in enumerate(cuts):
        for q in points:
            left, right = x[:, i] <= q, x[:, i] > q
            if w[left].sum() and w[right].sum():
                square = lambda part: (w[part] * y[part]).sum() ** 2 / w[part].sum()
                found = square(left) + square(right) - (w * y).sum() ** 2 / w.sum()
                if found > best[0] * (1 + 1e-9):
                    best = (found, (i, left, right))
    if best[1]:
        i, left, right = best[1]
        gain[i] += best[0]
        for part in (left, right):
            _gains(x[part], y[part], w[part], cuts, depth - 1, gain)


def test_importances_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(forests, "ROWS_AT_ONCE", 50)
    df, names = _rows(spark), ["a", "b", "c"]
    got = {(r["fold"], r["feature"]): r["weight"] for r in forests.fold_importances(df.repartition(5), "fold", [1, 2, 3], "id", "y", names, trees=3, depth=3, bins=8, tried=3).collect()}
    rows = df.filter("y is not null").withColumn("key", F.xxhash64(F.lit(17), "id")).toPandas()
    known = df.filter("y is not null").select(F.col("y"), "fold", *[F.col(c).alias(f"x{i}") for i, c in enumerate(names)])
    means, cuts = forests._fold_cuts(known, [1, 2, 3], 3, 8)
    for j, k in enumerate([1, 2, 3]):
        train = rows[rows.fold != k]
        assert means[j, 1] == pytest.approx(train.b.mean())
        x, y = train[names].fillna({"b": train.b.mean()}).to_numpy(), train.y.to_numpy()
        for i in range(3):
            quantiles = np.unique(np.quantile(x[:, i], np.arange(1, 8) / 8, method="inverted_cdf"))
            assert cuts[j][i].tolist() == pytest.approx(quantiles.tolist())
        share = np.zeros(3)
        for t in range(3 * j, 3 * j + 3):
            w = forests._DRAWS[forests.drawn_at_once(train.key.to_numpy().view(np.uint64), t // 4)[:, t % 4]]
            gain = np.zeros(3)
            _gains(x, y, w, cuts[j], 3, gain)
            share += gain / gain.sum()
        assert [got[(k, c)] for c in names] == pytest.approx((share / share.sum()).tolist(), abs=1e-9)


def test_draws_are_a_bootstrap():
    w = forests._DRAWS[forests.drawn_at_once(np.arange(200_000, dtype=np.uint64), 3)]
    assert w.mean(axis=0) == pytest.approx(np.ones(4), abs=0.01) and w.var(axis=0) == pytest.approx(np.ones(4), abs=0.02)
    assert np.abs(np.corrcoef(w.T) - np.eye(4)).max() < 0.01


def test_importances_are_near_those_of_a_forest_of_spark(spark):
    df, names = _rows(spark, 600), ["a", "b", "c"]
    run = models.cross_validate(df, "fold", [1, 2, 3], "id", "y", models.preparation(names), "RandomForestRegressor", {"n_estimators": 80, "max_depth": 4})
    mean = lambda table: {r["feature"]: r["w"] for r in table.groupBy("feature").agg(F.avg("weight").alias("w")).collect()}
    want = mean(models.importance_table(df, run.models, names))
    got = mean(forests.fold_importances(df, "fold", [1, 2, 3], "id", "y", names, trees=80, depth=4))
    assert got == pytest.approx(want, abs=0.04)


def test_shares_do_not_depend_on_partitions(spark, sf):
    """Spark's bootstrap follows the order of rows in partitions, so this failed with its forests."""
    first = QUERIES["importance_shares"](spark, sf).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert QUERIES["importance_shares"](spark, sf).collect() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_tables(spark):
    df = _rows(spark)
    args = ("fold", [1, 2], "id", "y", ["a", "c"])
    assert {r["weight"] for r in forests.fold_importances(df.filter("id < 0"), *args, trees=2, depth=2).collect()} == {0.0}
    constant = df.withColumn("a", F.lit(None).cast("double")).withColumn("c", F.lit(1.0))
    assert {r["weight"] for r in forests.fold_importances(constant, *args, trees=2, depth=2).collect()} == {0.0}
    with pytest.raises(ValueError):
        forests.fold_importances(df, *args, trees=1000, depth=20)
