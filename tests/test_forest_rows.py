"""Forests of many seeds compute their rows once."""

from cohortline.operators import forests, models


def test_forests_of_many_seeds_compute_their_rows_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "settle", lambda df: seen.append(df.columns) or df.localCheckpoint())
    df = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(60)], "y double, a double")
    models.repeated_forests(df.groupBy("y", "a").count().select("y", "a"), ["a"], "y", repeats=2)[0].collect()
    assert seen == [["y", "a"]]


def test_forests_grown_together_compute_their_rows_once(spark, monkeypatch):
    seen = []

    def kept(df):
        seen.append(df.columns)
        return df.localCheckpoint()

    monkeypatch.setattr(forests, "settle", kept)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)], "id long, y double, a double")
    weights, _ = forests.repeated_forests(df.groupBy("id", "y", "a").count().drop("count"), "id", ["a"], "y", repeats=2, trees=2, depth=1)
    assert weights.count() == 1
    assert seen[0] == ["id", "y", "a"]
