"""Repeated forests: all repeats of the study, grown together."""

import pytest
from pyspark.sql import functions as F

from cohortline.catalog import modelling
from cohortline.operators import forests, models


def test_repeated_forests_has_all_repeats(spark, monkeypatch):
    """The study fits 1000 forests."""
    asked = []

    def few(*args, repeats=1000, **more):
        asked.append(repeats)
        return made(*args, repeats=3, **more)

    made = models.repeated_forests
    monkeypatch.setattr(modelling.L, "repeated_forests", few)
    subjects = spark.createDataFrame([(i, "RandomForestRegressor", "stress_d", i % 7 + 0.5, i % 5) for i in range(30)], "snapshot_id int, Model string, Label string, true_mn double, n long")
    people = spark.createDataFrame([(i, i % 2, float(i % 11)) for i in range(30)], "snapshot_id int, lang int, age double")
    monkeypatch.setattr(modelling, "predictions", lambda *_: subjects)
    monkeypatch.setattr(modelling, "agreement", lambda df, keys: df)
    monkeypatch.setattr(modelling, "demographics", lambda *_: people)
    rows = modelling.repeated_forests(spark, "").collect()
    assert asked == [1000]
    assert {r["feature"] for r in rows} == {"n", "age", "lang"} and {r["runs"] for r in rows} == {3}


def test_jobs_dont_grow_with_repeats(spark, monkeypatch):
    """No model is fitted by itself; equal rows count as rows, and the order of rows decides nothing."""
    monkeypatch.setattr(models, "make_estimator", lambda *_: pytest.fail("fits one by one"))
    data = [(float(i % 8), float(i % 3), 1.0, 2.0 * (i % 8) + i % 3) for i in range(48)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    seen, grow = [], forests.grow
    monkeypatch.setattr(forests, "grow", lambda df, *a, **b: seen.append(df.agg(F.count("*"), F.count_distinct("__row")).first()) or grow(df, *a, **b))
    found = []
    for rows in (data, data[::-1]):
        weights, rho = models.repeated_forests(spark.createDataFrame(rows, "a double, b double, c double, y double"), ["a", "b", "c"], "y", repeats=40, trees=3)
        found.append(({r["feature"]: (round(r["importance"], 9), r["runs"]) for r in weights.collect()}, round(rho.first()["median"], 9)))
    assert [tuple(s) for s in seen] == [(48, 48)] * 2  # 24 distinct ones
    assert found[0] == found[1]
    own = found[0][0]
    assert {n for _, n in own.values()} == {40} and own["c"][0] == 0 and own["a"][0] > own["b"][0] > 0 and found[0][1] > 0.8


def test_forests_without_a_split_count(spark):
    """Every tree tries the constant feature only, or has no split to make: importances are 0, in all runs."""
    df = spark.createDataFrame([(1.0, 1.0, float(i)) for i in range(20)], "a double, b double, y double")
    weights, _ = models.repeated_forests(df, ["a", "b"], "y", repeats=4, trees=2)
    assert {(r["feature"], r["importance"], r["runs"]) for r in weights.collect()} == {("a", 0.0, 4), ("b", 0.0, 4)}
    with pytest.raises(ValueError, match="no rows"):
        models.repeated_forests(df.filter("a > 5"), ["a", "b"], "y", repeats=2)
