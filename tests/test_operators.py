"""Small hand-computed cases and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.functions import scalar as S
from cohortline.operators import baseline, ensemble, folds, lookups, prep, rows, smote, summary, testing, timezones, windows


def test_local_seconds_with_dst(spark):
    df = spark.createDataFrame([(1550000000.5, "America/New_York"), (1550000000.5, "America/Denver"),
                                # 2019-03-10 12:00 in New York, after the jump at 02:00
                                (1552233600.0, "America/New_York")], "t double, z string")
    got = [r[0] for r in df.select(S.local_seconds(F.col("t"), F.col("z"))).collect()]
    assert got == [52400.5, 45200.5, 43200.0]


def test_local_seconds_ignores_session_zone(spark):
    df = spark.createDataFrame([(1550000000.5, "America/New_York")], "t double, z string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert df.select(S.local_seconds(F.col("t"), F.col("z"))).first()[0] == 52400.5
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_next_and_nearest_key(spark, both_forms):
    table = spark.createDataFrame([(12000, "a"), (14000, "b")], "zipcode long, tz string")
    df = spark.createDataFrame([(1, 13000), (2, 99999), (3, 12000), (4, None), (5, 12100)], "id int, zipcode long")
    get = lambda mode: {r["id"]: r["tz"] for r in lookups.next_key_lookup(df, "zipcode", table, "tz", mode).collect()}
    assert get("next") == {1: "b", 2: None, 3: "a", 4: None, 5: "b"}
    assert get("nearest") == {1: "b", 2: "b", 3: "a", 4: None, 5: "a"}


def test_nearest_populated(spark, both_forms):
    data = [(0, None), (10, 1.0), (20, None), (30, 2.0), (33, None), (36, None), (45, 3.0), (60, None)]
    df = spark.createDataFrame(data, "at long, v double")
    got = {r["at"]: r["f"] for r in lookups.nearest_populated(df, "at", "v", "f").collect()}
    assert got == {0: 1.0, 10: 1.0, 20: 2.0, 30: 2.0, 33: 2.0, 36: 2.0, 45: 3.0, 60: 3.0}


def test_fallback_zone(spark, both_forms):
    zones = spark.createDataFrame([(1, "America/New_York"), (2, "America/Denver")], "zipcode long, tz string")
    # Row 3 has no zip but shares its sunrise with row 1; row 4 shares only its sunset with row 2.
    df = spark.createDataFrame(
        [(1, 1, 1550000000, 1000, 5000), (2, 2, 1550000000, 90000, 7000), (3, None, 1550000000, 1000, None), (4, None, 1550000000, None, 7000)],
        "id int, zipcode long, t long, up long, down long")
    out = timezones.correct_local_times(df, zones, survey_times=["t"], sunrise="up", sunset="down")
    assert {r["id"]: r["tz"] for r in out.collect()} == {1: "America/New_York", 2: "America/Denver", 3: "America/New_York", 4: "America/Denver"}


def test_shuffles_keep_multisets(spark, both_forms):
    rng = np.random.default_rng(0)
    data = [(i, "hot" if i % 3 else f"s{i % 7}", float(rng.integers(1, 6)) if i % 5 else None) for i in range(600)]
    df = spark.createDataFrame(data, "id long, s string, y double")
    out = baseline.with_baselines(df, "id", "y", "s").toPandas()
    assert sorted(out["y"].dropna()) == sorted(out["y_shuffled"].dropna())
    assert out["y"].isna().equals(out["y_shuffled"].isna())
    for _, part in out.groupby("s"):
        assert sorted(part["y"].dropna()) == sorted(part["y_shuffledWithinSubject"].dropna())
    again = baseline.with_baselines(df, "id", "y", "s").toPandas()
    assert out.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))


def test_k_folds_sizes(spark, both_forms):
    got = folds.k_folds(spark.range(103), "id", 5, seed=3).groupBy("fold").count().toPandas()["count"]
    assert got.sum() == 103 and got.max() - got.min() <= 1 and len(got) == 5


def test_group_folds_balance(spark, both_forms):
    data = [(g,) for g, n in zip("abcde", [5, 4, 3, 2, 2]) for _ in range(n)]
    df = spark.createDataFrame(data, "g string")
    got = folds.group_folds(df, "g", 2).groupBy("fold").agg(F.sum("n").alias("n")).toPandas()["n"]
    assert sorted(got) == [7, 9]


def test_true_rank_bins(spark, both_forms):
    df = spark.createDataFrame([(1, 30.0), (2, 10.0), (3, 20.0), (4, 40.0)], "id int, y double")
    assert {r["id"]: r["bin"] for r in folds.percentile_bin(df, "id", "y", 2).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_stratified_folds_balance_small_bins(spark, both_forms):
    df = spark.range(23).select("id", F.col("id").cast("double").alias("y"))
    out = folds.stratified_folds(df, "id", "y", 4, bins=10)
    for keys in (["fold"], ["bin", "fold"]):
        sizes = out.groupBy(*keys).count().toPandas()["count"]
        assert sizes.max() - sizes.min() <= 1


def test_group_stratified_folds_keep_subjects_whole(spark, both_forms):
    df = spark.range(500).select("id", (F.col("id") % 31).alias("s"), (F.col("id") % 7).cast("double").alias("y"))
    out = folds.with_fold(df, folds.stratified_group_folds(df, "s", "y", 5, bins=3, seed=1), "s")
    assert out.groupBy("s").agg(F.count_distinct("fold").alias("d")).filter("d > 1").count() == 0
    assert out.count() == 500


def test_wide_folds_round_trip(spark, both_forms):
    f = folds.k_folds(spark.range(20), "id", 3, seed=1)
    wide = folds.folds_to_wide(f, "id", 3)
    back = folds.folds_from_wide(wide, 3).filter("split = 'test'").select("row_id", "fold")
    assert back.exceptAll(f.select("id", "fold")).count() == 0 and back.count() == 20


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        folds.fold_plan("other", spark.range(3))


def test_window_of_three(spark, both_forms):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "t int, v double").withColumn("g", F.lit("a"))
    got = [[s[0] for s in r["steps"]] for r in windows.sliding_windows(df, ["g"], ["t"], ["v"], 3).orderBy("t").collect()]
    assert got == [[0, 0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 4]]


def test_window_chunks_share_history(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("g"), "id")
    got = windows.sliding_lists(df, ["g"], ["id"], ["v"], 4, "w", chunk_rows=5).toPandas()
    assert len(got) == 50
    for _, r in got.iterrows():
        want = [v for v in range(int(r["id"]) - 6, int(r["id"]) + 1, 2) if v >= 0]
        assert [s[0] for s in r["w"]] == want


def test_imputer_uses_train_only(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (2, None), (2, 100.0)], "f int, v double")
    out = prep.fit_transform_rows(prep.TrainImputer(inputCols=["v"]), df, F.col("f") == 1)
    assert [r["v"] for r in out.orderBy("f", "v").collect()] == [1.0, 2.0, 3.0, 2.0, 100.0]
    with pytest.raises(ValueError):
        prep.fit_transform_rows(prep.TrainImputer(inputCols=["v"]), df, None)


def test_train_statistics_ignore_test_rows(spark):
    base = spark.range(100).select((F.col("id") % 4).alias("f"), F.col("id").cast("double").alias("v"))
    changed = base.withColumn("v", F.when(F.col("f") == 2, F.col("v") * 1000).otherwise(F.col("v")))
    stats = lambda d: prep.fold_train_moments(d, "f", ["v"]).filter("f = 2").collect()
    assert stats(base) == stats(changed)


def test_scaler_population_sd_and_range(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    out = prep.TrainScaler(inputCols=["a", "b"]).fit(df).transform(df).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]
    out = prep.TrainScaler(inputCols=["a"], strategy="min-max", low=-1.0, high=1.0).fit(df).transform(df).orderBy("a").collect()
    assert [r["a"] for r in out] == [-1.0, 1.0]


def test_median_binarise(spark, both_forms):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 5.0)], "g string, v double")
    assert sorted(r["v"] for r in prep.binarise_at_median(df, ["v"], "g").collect()) == [0, 0, 0, 1]


def test_resampling_sizes(spark, both_forms):
    df = spark.range(90).select("id", F.when(F.col("id") < 20, 1).otherwise(0).alias("y"))
    count = lambda d: {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}
    assert count(prep.undersample(df, "y", "id")) == {0: 20, 1: 20}
    over = prep.oversample(df, "y", "id")
    assert count(over) == {0: 70, 1: 70}
    assert over.filter("y = 1").groupBy("id").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert prep.resample(df, "y", "id").count() == 90
    with pytest.raises(KeyError):
        prep.resample(df, "y", "id", "odd")


def test_neighbours_are_exact(spark, both_forms):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [5, 1, 1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = smote.minority_neighbours(df, "id", ["a", "b", "c"], k=5, block_rows=32).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == 300
    for _, r in got.iterrows():
        assert [n["neighbour"] for n in r["near"]] == list(np.argsort(d[r["id"]], kind="stable")[:5])


def test_neighbours_of_copies_are_exact(spark, both_forms):
    """More copies than neighbours, and distances that are equal: ties go to the smaller id."""
    x = np.array([[i % 7, 0.1 * (i % 3)] for i in range(200)]) + [1e6, 0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["near"] for r in smote.minority_neighbours(df, "id", ["a", "b"], k=4, block_rows=16).collect()}
    assert len(got) == 200
    for i, near in got.items():
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        d[i] = np.inf
        want = np.argsort(d, kind="stable")[:4]
        assert [n["neighbour"] for n in near] == list(want) and [n["distance"] for n in near] == list(d[want])
        assert [n["y"] for n in near] == [list(x[j]) for j in want]


def test_smote_rows_lie_between_neighbours(spark):
    df = spark.createDataFrame([(i, int(i >= 12), float(i), float(i * i)) for i in range(16)], "id long, y int, a double, b double")
    out = smote.smote(df, "y", "id", ["a", "b"], k=2).toPandas()
    assert out.groupby("y").size().to_dict() == {0: 12, 1: 12} and out["id"].is_unique
    made = out[out["id"] < 0]
    assert made["a"].between(12, 15).all() and made["b"].between(144, 225).all()


def test_label_encoding_and_one_hot(spark):
    df = spark.createDataFrame([("Yes",), ("no",), ("YES",)], "l string")
    classes = prep.class_table(df, "l")
    enc = prep.encode_label(df, "l", classes, "y")
    assert sorted(r["y"] for r in enc.collect()) == [0, 1, 1]
    assert {r["d"] for r in prep.decode_label(enc, "y", classes, "d").collect()} == {"yes", "no"}
    assert prep.distinct_values(df, "l", limit=10) == ["YES", "Yes", "no"]
    with pytest.raises(ValueError):
        prep.distinct_values(df, "l", limit=2)
    assert prep.one_hot(df, "l", ["no"]).filter("l_no = 1").count() == 1


def test_join_blocks(spark):
    df = spark.createDataFrame([([1.0], [2.0], [[1.0], [2.0]], [[3.0], [4.0]])], "a array<double>, b array<double>, s array<array<double>>, t array<array<double>>")
    assert prep.join_blocks(df, ["a", "b"]).first()["features"] == [1.0, 2.0]
    assert prep.join_blocks(df, ["s", "t"]).first()["features"] == [[1.0, 3.0], [2.0, 4.0]]


def test_hierarchy(spark):
    df = spark.createDataFrame([(0.8, 0.5)], "c double, n double")
    assert df.select(ensemble.up_the_tree(F.col("c"), [F.col("n")])).first()[0] == pytest.approx(0.45)


def test_stacking_refuses_duplicates(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    good = spark.createDataFrame([(1, 0.5)], "id int, p double")
    assert {r["id"]: r["s"] for r in ensemble.stacked_feature(df, good, "id", "p", "s").collect()} == {1: 0.5, 2: None}
    with pytest.raises(Exception, match="duplicate prediction key"):
        ensemble.stacked_feature(df, good.union(good), "id", "p", "s").collect()


def test_rows_helpers(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, x string, y double")
    with pytest.raises(ValueError):
        rows.project(df, ["id", "stai.traitaudit"])
    with pytest.raises(TypeError):
        rows.project(df, ["x"], numeric=True)
    assert rows.drop_all_null(df, ["x", "y"]).count() == 1
    assert rows.safe_names(spark.createDataFrame([(1,)], "`stress.d` int")).columns == ["stress_d"]
    assert rows.missing_columns(df, ["id", "z"]) == ["z"]


def test_large_subject_ids_survive(spark):
    df = spark.createDataFrame([("10497196978679838720", 1.0, 2.0), ("10497196978679838721", 1.0, 2.0)], "snapshot_id string, True_value double, Predicted_value double")
    assert summary.agreement(df, ["snapshot_id"]).select("snapshot_id").distinct().count() == 2


def test_paired_and_holm(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=20), rng.normal(size=20) + 0.5
    data = [(i, "a", float(v)) for i, v in enumerate(a)] + [(i, "b", float(v)) for i, v in enumerate(b)] + [(99, "a", 1.0)]
    df = spark.createDataFrame(data, "s int, v string, x double")
    got = testing.paired_t(df, "s", "v", "x", [("a", "b")]).first()
    d = a - b
    assert got["n"] == 20 and got["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(20)))
    assert got["ci_low"] < d.mean() < got["ci_high"]
    p = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.03)], "first string, second string, p_value double")
    adj = {(r["first"], r["second"]): r["p_adj"] for r in testing.holm(p).collect()}
    assert adj == {("a", "b"): pytest.approx(0.03), ("b", "c"): pytest.approx(0.06), ("a", "c"): pytest.approx(0.06)}


def test_within_slope_equals_within_ols(spark):
    rng = np.random.default_rng(9)
    s = rng.integers(0, 10, 200)
    x = rng.normal(size=200) + s
    y = 2 * x - 3 * s + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "x": x, "y": y}))
    one, two = testing.within_slope(df, "s", "y", "x").first(), testing.within_subject_ols(df, "s", "y", ["x"]).first()
    assert one["slope"] == pytest.approx(two["estimate"]) and one["t"] == pytest.approx(two["t"])
    dummies = np.column_stack([x, *[(s == g).astype(float) for g in range(10)]])
    beta = np.linalg.lstsq(dummies, y, rcond=None)[0]
    resid = y - dummies @ beta
    se = np.sqrt(resid @ resid / (200 - 11) * np.linalg.inv(dummies.T @ dummies)[0, 0])
    assert one["slope"] == pytest.approx(beta[0]) and one["std_error"] == pytest.approx(se)


def test_first_per_key_and_best(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in rows.first_per_key(df, ["k"], ["o"]).collect()} == {"a": "y", "b": "z"}
    assert {r["k"]: r["o"] for r in summary.best_per_group(df, ["k"], "o", ["v"]).collect()} == {"a": 2, "b": 5}


def test_compliance_and_weights(spark, both_forms):
    df = spark.createDataFrame([("a", 3.0), ("b", -6.0), ("c", 1.0)], "f string, w double")
    got = [(r["f"], round(r["share"], 2)) for r in summary.weight_share(df, "f", "w").orderBy("rank").collect()]
    assert got == [("b", 0.6), ("a", 0.3), ("c", 0.1)]


def test_padding_and_arg_max(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "a array<int>")
    row = df.select(S.pad_left(F.col("a"), 2, F.lit(0)), S.pad_left(F.col("a"), 6, F.lit(0)), S.pad_right(F.col("a"), 3, F.lit(0)),
                    S.pad_right(F.col("a"), 5, F.lit(9)), S.arg_max(F.col("a"))).first()
    assert list(row) == [[3, 4], [0, 0, 1, 2, 3, 4], [1, 2, 3], [1, 2, 3, 4, 9], 3]
