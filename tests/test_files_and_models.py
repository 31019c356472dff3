"""Round trips through files, text operators, models and the composed study."""

import gzip
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from cohortline.operators import models as L
from cohortline.operators import prep, text
from cohortline.operators.folds import k_folds
from cohortline.plans.stages import needs, run_stages
from cohortline.plans.study import Experiment, Study, assign_folds, prepare_observations, run_experiments, subject_results
from cohortline.sources import readers as R
from cohortline.sources import writers as W


def put(path, body):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(body)
    return path


def test_csv_gzip_nulls_and_names(spark, folder):
    path = put(f"{folder}/a.csv", "snapshot_id,stress.d,x\n10497196978679838720,1.5,NULL\n7,NaN,2\n")
    df = R.read_csv(spark, path, "snapshot_id string, `stress.d` double, x int", null_value="NULL")
    assert [tuple(r) for r in df.orderBy("snapshot_id").collect()] == [("10497196978679838720", 1.5, None), ("7", None, 2)]
    assert df.columns == ["snapshot_id", "stress_d", "x"]
    with gzip.open(f"{folder}/b.csv.gz", "wt") as f:
        f.write("a,b\n1,2\n3,4\n")
    assert R.read_csv(spark, f"{folder}/b.csv.gz", "a int, b int", partitions=3).agg(F.sum("b")).first()[0] == 6


def test_lookup_and_column_list(spark, folder):
    path = put(f"{folder}/zip.txt", "10001=America/New_York\n80201=America/Denver\nbroken\n")
    assert {r["key"]: r["value"] for r in R.read_key_values(spark, path).collect()} == {10001: "America/New_York", 80201: "America/Denver"}
    assert R.read_column_list(spark, put(f"{folder}/cols.txt", "id\nstress.d\n\n")) == ["id", "stress_d"]
    assert R.from_frame(spark.range(3), "row", ["id"]).orderBy("id").first()["row"] == 0


def test_union_of_layouts_with_path_tags(spark, folder):
    put(f"{folder}/predictions/ElasticNet/p.csv", "id,Predicted_value\n1,2.0\n2,NA\n")
    put(f"{folder}/neural/MLP/q.csv", "id,extra\n3,x\n")
    df = R.read_union(spark, [f"{folder}/predictions/*/*.csv", f"{folder}/neural/*/*.csv"], {"Model": r"/([^/]+)/[^/]+\.csv$"})
    assert df.columns == ["Model", "Predicted_value", "extra", "id"]
    assert {(r["id"], r["Model"], r["Predicted_value"]) for r in df.collect()} == {(1, "ElasticNet", 2.0), (2, "ElasticNet", None), (3, "MLP", None)}


def test_hyperparameter_files(spark, folder):
    put(f"{folder}/hp/fold=1/p.txt", "Best:\n\tMODEL__max_depth: 50\n\tMODEL__n_estimators: 100\n")
    put(f"{folder}/hp/fold=2/p.txt", "\tMODEL__n_estimators: 200\n")
    df = R.read_hyperparameters(spark, f"{folder}/hp/*/*.txt", ["MODEL__max_depth", "MODEL__n_estimators"], {"fold": r"fold=(\d+)/"})
    assert {(r["fold"], r["MODEL__max_depth"], r["MODEL__n_estimators"]) for r in df.collect()} == {("1", "50", "100"), ("2", None, "200")}


def test_csv_sink_layout_and_append(spark, folder):
    df = spark.createDataFrame([(1, None)], "id int, x string")
    W.append_results(df, f"{folder}/out", ["x", "missing", "id"])
    W.append_results(df, f"{folder}/out", ["x", "missing", "id"])
    raw = spark.read.option("header", True).csv(f"{folder}/out")
    assert raw.columns == ["x", "missing", "id"] and [tuple(r) for r in raw.collect()] == [("NA", "NA", "1")] * 2


def test_partitioned_results_and_splits(spark, folder):
    df = spark.range(20).select("id", (F.col("id") % 2 + 1).cast("int").alias("fold"), F.lit("M").alias("Model"), F.lit("L").alias("Label"))
    W.write_results(df, f"{folder}/res")
    assert os.path.isdir(f"{folder}/res/Model=M/Label=L/fold=1") and spark.read.parquet(f"{folder}/res").count() == 20
    W.write_splits(df, "fold", [1, 2], f"{folder}/splits")
    back = spark.read.parquet(f"{folder}/splits").filter("for_fold = 1")
    assert back.filter("split = 'test' and fold <> 1 or split = 'train' and fold = 1").count() == 0 and back.count() == 20
    name = W.fold_file_name("stratified", "stress_d", 10, 3748)
    W.write_folds(k_folds(spark.range(7), "id", 2), f"{folder}/folds", "id", 2, wide=True, name=name)
    wide = spark.read.option("header", True).csv(f"{folder}/folds/{name}")
    assert set(wide.columns) == {"Fold1_train", "Fold2_train", "Fold1_test", "Fold2_test"} and wide.count() == 4
    W.write_features(df, ["id"], "fold", f"{folder}/feat")
    assert spark.read.parquet(f"{folder}/feat").columns == ["id", "fold"]


def test_run_manifest_and_log(spark, folder):
    W.save_run({"data": spark.range(3), "best": {"alpha": 0.1}}, f"{folder}/run", spark)
    back = W.load_run(f"{folder}/run", spark)
    assert back["data"].count() == 3 and back["best"] == {"alpha": 0.1}
    for k in (1, 2):
        W.log_run(spark, f"{folder}/log", "r1", "ElasticNet", "stress_d", k, {"alpha": 0.1})
    assert spark.read.parquet(f"{folder}/log").filter("params['alpha'] = '0.1'").count() == 2


def test_tokens_and_pmi(spark):
    df = spark.createDataFrame([(1, "Red fox. Red fox runs!"), (2, "The x1 fox; red")], "id int, t string")
    sents = text.sentence_table(df, "id", "t", stop_words=["the"])
    assert [r["words"] for r in sents.orderBy("id", "sent").collect()] == [["red", "fox"], ["red", "fox", "runs"], ["fox", "red"]]
    vocab = {r["ngram"]: r["pmi"] for r in text.pmi_vocabulary(df, "id", "t", 1, 2, min_pmi=0.0, stop_words=["the"], exclude=["runs"]).collect()}
    # 7 tokens; "red fox" occurs twice, red 3 times, fox 3 times.
    assert vocab["red fox"] == pytest.approx(np.log2(2 * 7 / 9)) and "runs" not in vocab and vocab["red"] is None
    with pytest.raises(ValueError):
        text.pmi_vocabulary(df, "id", "t", 1, 5)


def test_pmi_of_rare_words_shuffles_ngrams_once(spark, monkeypatch):
    """Words found in tasks and words that reach their documents by joins give the same counts; null ids and texts, ids used twice."""
    rows = [(1, "a b c d. a b"), (1, "a b c e"), (None, "b c a b"), (None, None), (4, ""), (5, "f")]
    df = spark.createDataFrame(rows, "id int, t string")
    counts, found = Counter(), []
    for sentence in ("a b c d", "a b", "a b c e", "b c a b", "f"):
        w = sentence.split()
        counts.update(" ".join(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if " " not in g)
    want = {g: (c, np.log2(c) + (len(g.split()) - 1) * np.log2(total) - sum(np.log2(counts[w]) for w in g.split())) for g, c in counts.items() if " " in g}
    for heavy in (10_000, 1):
        monkeypatch.setattr(text, "HEAVY_WORDS", heavy)
        out = text.pmi_vocabulary(df, "id", "t", 1, 4, min_pmi=-100.0).collect()
        found.append({r["ngram"]: (r["n"], r["c"], r["pmi"]) for r in out})
        assert len(out) == len(counts) == len(found[-1])
    assert found[0] == found[1]
    for g, (c, pmi) in want.items():
        n, got, value = found[0][g]
        assert (n, got) == (len(g.split()), c) and value == pytest.approx(pmi)
    plan = text.pmi_vocabulary(df, "id", "t", 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ngram" in plan and "hashpartitioning(n#" not in plan


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "a")], "id int, t string")
    out = text.tfidf(df, "id", "t", min_df=1)
    norms = out.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms)
    only = text.tfidf(df, "id", "t", min_df=2, fit_on=df.filter("id < 3"))
    assert {r["term"] for r in only.collect()} == {"a"}
    vocab = spark.createDataFrame([("b",)], "ngram string")
    assert {r["term"] for r in text.tfidf(df, "id", "t", 1, vocabulary=vocab).collect()} == {"b"}


def test_word_ids(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, "c"), (3, "")], "id int, t string")
    index = text.word_index(df, "t", cap=3)
    assert {r["word"]: r["idx"] for r in index.collect()} == {"a": 1, "b": 2}
    got = {r["id"]: r["ids"] for r in text.word_id_sequences(df, "id", "t", index, 4).collect()}
    assert got == {1: [2, 1, 1, 0], 2: [0] * 4, 3: [0] * 4}


def frame(spark, n=240):
    rng = np.random.default_rng(11)
    s, a, b = rng.integers(0, 20, n), rng.normal(size=n), rng.normal(size=n)
    y = 2 * a - b + rng.normal(scale=0.3, size=n) + 3
    rows = [(int(i), f"s{g}", float(u), float(v), float(w)) for i, (g, u, v, w) in enumerate(zip(s, a, b, y))]
    return spark.createDataFrame(rows, "id long, snapshot_id string, a double, b double, y double"), np.column_stack([a, b]), y


def coordinate_descent(x, y, alpha, ratio, rounds=3000):
    """Elastic net of the form 1/(2n) |y - xb|^2 + alpha * (ratio |b|_1 + (1 - ratio)/2 |b|^2)."""
    xc, yc = x - x.mean(0), y - y.mean()
    n, beta = len(y), np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(beta)):
            r = yc - xc @ beta + xc[:, j] * beta[j]
            z = xc[:, j] @ r / n
            beta[j] = np.sign(z) * max(abs(z) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    return beta


def test_elastic_net_parity(spark):
    df, x, y = frame(spark)
    data = Pipeline(stages=L.preparation(["a", "b"], scale=None)).fit(df).transform(df)
    for alpha, ratio in ((0.1, 0.5), (0.5, 0.9), (1.0, 0.2)):
        got = L.make_estimator("ElasticNet", "y", {"alpha": alpha, "l1_ratio": ratio}).fit(data)
        assert np.allclose(got.coefficients.toArray(), coordinate_descent(x, y, alpha, ratio), atol=1e-4)


def test_forest_depth_is_capped(spark):
    e = L.make_estimator("RandomForestRegressor", "y", {"max_depth": None, "n_estimators": 7})
    assert e.getMaxDepth() == 30 and e.getNumTrees() == 7
    with pytest.raises(ValueError):
        L.make_estimator("RandomForestClassifier", "y", {"max_depth": 50})
    with pytest.raises(KeyError):
        L.make_estimator("Nothing", "y")


def test_grid_and_best():
    grid = L.parameter_grid([{"a": [1, 2], "b": [3]}, {"c": [4]}])
    assert grid == [{"a": 1, "b": 3}, {"a": 2, "b": 3}, {"c": 4}]
    table = [{"params": {"a": 1}, "score": 0.5}, {"params": {"a": 2}, "score": 0.2}, {"params": {"a": 3}, "score": None}]
    assert L.pick_best(table, "max") == {"a": 1} and L.pick_best(table, "min") == {"a": 2}


def test_nested_search_save_load_and_import(spark, folder):
    df, _, y = frame(spark)
    df = df.withColumn("fold", (F.col("id") % 2 + 1).cast("int"))
    grid = L.parameter_grid({"alpha": [0.01, 5.0], "l1_ratio": [0.5]})
    run = L.nested_cross_validate(df, "fold", [1, 2], "id", "y", L.preparation(["a", "b"]), "ElasticNet", grid, "smape", inner_k=2, group="snapshot_id", inner_bins=3)
    best = L.tuning_table(df, run).filter("best").collect()
    assert [r["params"]["alpha"] for r in best] == ["0.01", "0.01"]
    oof = run.predictions
    assert oof.count() == 240 and oof.select("id").distinct().count() == 240
    err = oof.agg(F.avg((F.col("True_value") - F.col("Predicted_value")) ** 2)).first()[0]
    assert err < np.var(y) / 5
    L.save_models(run.models, f"{folder}/m")
    loaded = L.load_models(f"{folder}/m", [1, 2])
    a = L.score_external(df, run.models, "id").groupBy("id").agg(F.avg("Predicted_value").alias("p")).toPandas().sort_values("id")
    b = L.score_external(df, loaded, "id").groupBy("id").agg(F.avg("Predicted_value").alias("p")).toPandas().sort_values("id")
    assert np.allclose(a["p"], b["p"])
    weights = L.importance_table(df, run.models, ["a", "b"]).groupBy("feature").agg(F.avg("weight").alias("w")).toPandas().set_index("feature")["w"]
    assert weights["a"] > 0 > weights["b"]


def test_forest_importances_and_user_factory(spark):
    from pyspark.ml.regression import RandomForestRegressor

    df, _, _ = frame(spark)
    df = df.withColumn("fold", (F.col("id") % 2 + 1).cast("int"))
    factory = lambda trees=5: RandomForestRegressor(numTrees=trees, seed=1)
    run = L.cross_validate(df, "fold", [1, 2], "id", "y", L.preparation(["a", "b"]), factory, {"trees": 3}, name="mine")
    total = L.importance_table(df, run.models, ["a", "b"]).groupBy("fold").agg(F.sum("weight").alias("t")).collect()
    assert all(r["t"] == pytest.approx(1.0) for r in total)
    assert run.predictions.select("Model").distinct().collect()[0][0] == "mine"


def test_metric_evaluator_in_cross_validator(spark):
    df, _, _ = frame(spark)
    data = Pipeline(stages=L.preparation(["a", "b"])).fit(df).transform(df)
    est = L.make_estimator("ElasticNet", "y", {"l1_ratio": 0.5})
    grid = ParamGridBuilder().addGrid(est.regParam, [0.01, 10.0]).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=L.MetricEvaluator("mse", "y"), numFolds=2, seed=1)
    assert cv.fit(data).bestModel.getOrDefault("regParam") < 1.0


def test_feature_selection_slot(spark):
    df, _, _ = frame(spark)
    df = df.withColumn("flat", F.lit(1.0))
    data = Pipeline(stages=L.preparation(["a", "b", "flat"], scale=None)).fit(df).transform(df)
    kept = L.selection_stage("variance", "y").fit(data)
    assert list(kept.selectedFeatures) == [0, 1]


def test_stages(spark):
    @needs("data")
    def double(t):
        return {"twice": t["data"].withColumn("v", F.col("id") * 2)}

    out = run_stages([double], {"data": spark.range(3)})
    assert out["twice"].agg(F.sum("v")).first()[0] == 6
    with pytest.raises(ValueError, match="needs data"):
        run_stages([double])


def test_whole_study(spark):
    df, _, _ = frame(spark)
    study = Study("snapshot_id", "id", "y", ["a", "b"], folds=2, bins=3, inner_folds=2, experiments=[
        Experiment("ElasticNet", L.parameter_grid({"alpha": [0.01, 1.0]})), Experiment("LinearRegression")])
    ready = assign_folds(prepare_observations(df, study), study).persist()
    table, runs = run_experiments(ready, study, ["y", "y_shuffled", "y_shuffledWithinSubject"])
    assert table.count() == 240 * 6 and len(runs) == 6
    out = subject_results(table, ready, study, pair=("ElasticNet", "LinearRegression"))
    rho = {(r["Model"], r["Label"]): r["rho_mn"] for r in out["summary"].collect()}
    assert rho[("ElasticNet", "y")] > 0.8 > rho[("ElasticNet", "y_shuffled")]
    assert ("RFLR", "y") in rho
    tests = out["tests"].collect()
    assert len(tests) == 4 and all(r["p_value"] < 1e-4 for r in tests)
    ready.unpersist()


def test_multilabel_targets(spark):
    df = spark.createDataFrame([("1", "x"), ("-2", "3")], "a string, b string")
    assert [r["targets"] for r in prep.multilabel_targets(df, ["a", "b"]).collect()] == [[1, 0], [0, 1]]


def test_models_share_a_folds_preparation(spark, monkeypatch):
    rows = [(i, i % 3 + 1, int((i * 7) % 10 > 4), float(i % 10), float((i * i) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, fold int, y int, a double, b double")
    models, stages = {"DecisionTreeClassifier": {"max_depth": 3}, "LogisticRegression": {"max_iter": 20}}, L.preparation(["a", "b"])
    alone = {m: L.cross_validate(df, "fold", [1, 2, 3], "id", "y", stages, m, p, classes=["no", "yes"]) for m, p in models.items()}
    fits, fit = [], type(stages[0])._fit
    monkeypatch.setattr(type(stages[0]), "_fit", lambda self, data: fits.append(1) or fit(self, data))
    runs = L.cross_validate_each(df, "fold", [1, 2, 3], "id", "y", stages, models, classes=["no", "yes"])
    assert len(fits) == 3
    for m in models:
        assert sorted(map(tuple, runs[m].predictions.collect())) == sorted(map(tuple, alone[m].predictions.collect()))
