"""Several models on one table: small tables in few partitions, test rows scored once."""

from cohortline.operators import models as L


def test_models_dont_meet_hundreds_of_small_partitions(spark, monkeypatch):
    rows = [(i, i % 3 + 1, int((i * 7) % 10 > 4) if i else None, float(i % 10), float((i * i) % 11)) for i in range(61)]
    df = spark.createDataFrame(rows, "id int, fold int, y int, a double, b double")
    seen, make = [], L.make_estimator

    def watched(*args):
        made = make(*args)
        fit = made.fit
        made.fit = lambda data: seen.append(data.rdd.getNumPartitions()) or fit(data)
        return made

    monkeypatch.setattr(L, "make_estimator", watched)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        runs = L.cross_validate_each(
            df, "fold", [1, 2, 3], "id", "y", L.preparation(["a", "b"]), {"DecisionTreeClassifier": {"max_depth": 3}, "LinearSVC": {"max_iter": 5}}, classes=["no", "yes"]
        )
        rows = {m: run.predictions for m, run in runs.items()}
        assert len(seen) == 6 and max(seen) <= L.LEAST_PARTS
        for m, made in rows.items():
            assert made.count() == 60 and made.select("id").distinct().count() == 60
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "InMemory" not in plan and "ExistingRDD" in plan, m  # scored already, by all models in one pass
        assert "no_probability" in rows["DecisionTreeClassifier"].columns and "no_probability" not in rows["LinearSVC"].columns
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_tables_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(L, "CELLS_PER_PART", 10)
    monkeypatch.setattr(L, "LEAST_PARTS", 1)
    df = spark.range(15)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for most, parts in ((16, 2), (2, 2), (1, 1)):
        spark.conf.set("spark.sql.shuffle.partitions", str(most))
        held, n = L._held_by_size(df)
        assert n == parts == held.rdd.getNumPartitions() and held.count() == 15
        held.unpersist()
    spark.conf.set("spark.sql.shuffle.partitions", before)
