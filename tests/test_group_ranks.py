"""Spearman's rho of small and large groups in one table, next to pandas."""

import numpy as np
import pandas as pd
import pytest

from cohortline.operators import rank


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_any_size_give_the_same_rho(spark, both_forms):
    rng = np.random.default_rng(5)
    rows = []
    for key, size in ((None, 30), ("a", 400), ("b", 3), ("c", 1), ("d", 50), ("e", 200)):
        x = np.round(rng.normal(size=size), 1)
        y = np.round(x + rng.normal(size=size), 0) if key != "d" else np.ones(size)
        rows += [(key, float(u), float(v)) for u, v in zip(x, y)]
    rows += [("e", 1.0, None), ("e", float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    got = {r["k"]: r for r in rank.spearman(df, ["k"], "x", "y").collect()}
    assert len(got) == 6
    for key, r in got.items():
        own = pd.DataFrame([t[1:] for t in rows if t[0] == key]).dropna()
        assert r["n_pairs"] == len(own)
        if key in ("c", "d"):
            assert r["rho"] is None
        else:
            assert r["rho"] == pytest.approx(np.corrcoef(own[0].rank(), own[1].rank())[0, 1], abs=1e-12)


def test_small_groups_are_shuffled_by_pairs_and_by_group_alone(spark):
    df = spark.createDataFrame([(i % 7, float(i % 5), float(i % 3)) for i in range(100)], "k int, x double, y double")
    assert "Join" not in plan_text(rank.spearman(df, ["k"], "x", "y"))
