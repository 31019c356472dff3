"""Sums, counts, forests, buckets and blocks next to plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.catalog import learning
from cohortline.functions.distributions import student_t_p, student_t_quantile, t_tail
from cohortline.operators import blocks, forests, hierarchy, moments, naive_bayes, smote
from cohortline.operators import models as L
from cohortline.operators.metrics import evaluate
from cohortline.operators.text import tfidf

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def line_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3)) * [1.0, 20.0, 0.3] + [5.0, -100.0, 0.0]
    y = 3 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=240)
    holes = rng.random(240) < 0.15
    return [
        (i, float(x[i, 0]), None if holes[i] else float(x[i, 1]), float(x[i, 2]), float(y[i]) if i % 40 else None, i % 4 + 1, i // 4 % 3 + 1)
        for i in range(240)
    ]


@pytest.fixture(scope="module")
def lines(spark, line_rows):
    return spark.createDataFrame(line_rows, "id long, a double, b double, c double, y double, fold int, inner int")


def plain_fit(rows, alpha, ratio):
    """(means, sds, standardised slopes, label mean) of an elastic net by long coordinate descent over the rows themselves."""
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    mean = np.nanmean(x, axis=0)
    x = np.where(np.isnan(x), mean, x)
    sd = x.std(axis=0)
    z, y = (x - mean) / sd, np.array([r[4] for r in rows])
    b, left = np.zeros(3), y - y.mean()
    for _ in range(3000):
        for i in range(3):
            raw = z[:, i] @ (left + z[:, i] * b[i]) / len(y)
            new = np.sign(raw) * max(abs(raw) - alpha * ratio, 0) / (z[:, i] @ z[:, i] / len(y) + alpha * (1 - ratio))
            left = left + z[:, i] * (b[i] - new)
            b[i] = new
    return mean, sd, b, y.mean()


def plain_guess(rows, fit):
    mean, sd, b, y = fit
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    return y + (np.where(np.isnan(x), mean, x) - mean) / sd @ b


def test_nested_fits_equal_fits_on_the_rows(lines, line_rows):
    grid = [(0.05, 0.5), (0.5, 0.9), (2.0, 0.5)]
    run = moments.nested_elastic_net(lines, "fold", [1, 2, 3, 4], "id", "y", FEATURES, dict.fromkeys([1, 2, 3, 4], "inner"), 3, grid)
    known = [r for r in line_rows if r[4] is not None]
    got = {r["id"]: r["Predicted_value"] for r in run.predictions.collect()}
    assert len(got) == len(known)
    scores = {(r["fold"], r["set"]): (r["score"], r["best"]) for r in run.tuning.collect()}
    for k in (1, 2, 3, 4):
        train = [r for r in known if r[5] != k]
        means = []
        for s, (alpha, ratio) in enumerate(grid):
            errors = []
            for j in (1, 2, 3):
                test = [r for r in train if r[6] == j]
                guess = plain_guess(test, plain_fit([r for r in train if r[6] != j], alpha, ratio))
                errors.append(np.mean((guess - [r[4] for r in test]) ** 2))
            means.append(np.mean(errors))
            assert scores[k, s][0] == pytest.approx(means[-1], rel=1e-8)
        best = int(np.argmin(means))
        assert [s for s in range(3) if scores[k, s][1]] == [best]
        test = [r for r in known if r[5] == k]
        for r, p in zip(test, plain_guess(test, plain_fit(train, *grid[best]))):
            assert got[r[0]] == pytest.approx(p, rel=1e-7)


def test_any_metric_chooses_in_a_second_pass(lines):
    grid = [(0.05, 0.5), (2.0, 0.5)]
    run = moments.nested_elastic_net(lines, "fold", [1, 2], "id", "y", FEATURES, {1: "inner", 2: "inner"}, 3, grid, "mae")
    by_mse = moments.nested_elastic_net(lines, "fold", [1, 2], "id", "y", FEATURES, {1: "inner", 2: "inner"}, 3, grid, "mse")
    best = {(r["fold"], r["set"]) for r in run.tuning.collect() if r["best"]}
    assert best == {(r["fold"], r["set"]) for r in by_mse.tuning.collect() if r["best"]} == {(1, 0), (2, 0)}


def test_least_squares_and_constant_features(spark):
    rows = [(i, float(i), 7.0, 2.0 * i + 1, i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, fold int")
    run = moments.nested_elastic_net(df, "fold", [0, 1], "id", "y", ["a", "b"], {0: "fold", 1: "fold"}, 1, [(0.0, 0.0)])
    # with one parameter set nothing is searched; inner folds only number the blocks
    assert run.tuning.count() == 0


def test_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 40))
    x[:, 1] = x[:, 0] + 0.01 * rng.normal(size=300)
    g, p = x.T @ x / 300, x.T @ (x[:, 0] * 2 - x[:, 5] + rng.normal(size=300)) / 300
    for first, second in ((0.05, 0.1), (0.3, 0.0), (0.0, 0.5)):
        b = moments.descend(g, p, first, second, np.zeros(40))
        slope = p - g @ b - second * b
        assert np.all(np.abs(slope[b == 0]) <= first + 1e-9) and np.allclose(slope[b != 0], first * np.sign(b[b != 0]), atol=1e-9)


def test_learning_curve_equals_separate_fits(lines):
    df = lines.withColumn("u", F.pmod(F.col("id") * 37, F.lit(100)) / 100)
    got = {r["train_share"]: r for r in moments.linear_learning_curve(df, "fold", [1, 2, 3, 4], "id", "y", FEATURES, (0.3, 1.0), F.col("u")).collect()}
    for share in (0.3, 1.0):
        run = L.cross_validate(df, "fold", [1, 2, 3, 4], "id", "y", L.preparation(FEATURES), "LinearRegression", prepare_train=lambda t, s=share: t.filter(F.col("u") < s))
        want = [r["rmse"] for r in evaluate(run.predictions, "True_value", "Predicted_value", ["rmse"], ["fold"]).collect()]
        assert got[share]["folds"] == 4 and got[share]["score_mean"] == pytest.approx(np.mean(want), rel=1e-8)
        assert got[share]["score_sd"] == pytest.approx(np.std(want), rel=1e-6)


# Naive Bayes


def test_naive_bayes_like_plain_counts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        y = i % 3
        words = [f"w{int(v)}" for v in rng.integers(0, 12, rng.integers(0, 9))] + [f"c{y}"] * int(rng.integers(0, 2)) + [f"only{i}"]
        rows.append((i, ["x", "y", "z"][y] if i % 20 else None, words if i % 11 else [], i // 3 % 3))
    df = spark.createDataFrame(rows, "id long, label string, words array<string>, fold int")
    got = {r["id"]: r for r in naive_bayes.out_of_fold(df, "id", "label", "words", "fold", ["x", "y", "z"]).collect()}
    known = [r for r in rows if r[1]]
    assert set(got) == {r[0] for r in known}
    for i, _, words, fold in known:
        train = [r for r in known if r[3] != fold]
        counts = {c: Counter(w for r in train if r[1] == c for w in r[2]) for c in "xyz"}
        vocabulary = set().union(*counts.values())
        scores = []
        for c in "xyz":
            total = sum(counts[c].values())
            s = math.log((sum(r[1] == c for r in train) + 1) / (len(train) + 3))
            scores.append(s + sum(math.log((counts[c][w] + 1) / (total + len(vocabulary))) for w in words if w in vocabulary))
        assert got[i]["scores"] == pytest.approx(scores, rel=1e-9)
        assert got[i]["Predicted_value"] == "xyz"[int(np.argmax(np.round(scores, 12)))]


# Forests


def test_forests_equal_trees_grown_one_by_one(spark):
    rng = np.random.default_rng(7)
    data = [(i, float(rng.integers(0, 9)), float(rng.normal()), float(rng.integers(0, 3)), float(rng.normal())) for i in range(50)]
    df = spark.createDataFrame([*data, (99, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double")
    trees, depth, bins = 6, 3, 8
    splits, cuts = forests.grow(df, "id", "y", FEATURES, trees, depth, bins, tried=3)
    got = {(r["tree"], r["node"]): r for r in splits.collect()}
    drawn = {(r[0], r[1]): r[2] for r in df.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")).select("id", "t", forests.drawn(17, F.col("id"), F.col("t"))).collect()}
    binned = {r[0]: [sum(v > q for q in cuts[f]) for f, v in enumerate(r[1:4])] for r in data}
    for t in range(trees):
        todo = {1: [(r, drawn[r[0], t]) for r in data if drawn[r[0], t]]}
        for node in range(1, 2**depth):
            rows, best = todo.get(node, []), None
            n = sum(w for _, w in rows)
            s = sum(w * r[4] for r, w in rows)
            for f in range(3):
                for cut in range(bins):
                    left = [(r, w) for r, w in rows if binned[r[0]][f] <= cut]
                    nl, sl = sum(w for _, w in left), sum(w * r[4] for r, w in left)
                    if 0 < nl < n:
                        gain = sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n
                        if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)) and any(binned[r[0]][f] == cut for r, _ in rows):
                            best = (gain, f, cut)
            if best is None:
                assert (t, node) not in got
                continue
            r = got[t, node]
            assert (r["feature"], r["cut"]) == best[1:] and r["gain"] == pytest.approx(best[0])
            todo[2 * node] = [x for x in rows if binned[x[0][0]][best[1]] <= best[2]]
            todo[2 * node + 1] = [x for x in rows if binned[x[0][0]][best[1]] > best[2]]
    guesses = {(r["seed"], r["id"]): r["p"] for r in forests.predict(df.filter("id < 50"), "id", FEATURES, splits, cuts, depth, 3).collect()}
    for r in data:
        for seed in (0, 1):
            values = []
            for t in range(3 * seed, 3 * seed + 3):
                node, value = 1, None
                while (t, node) in got:
                    s = got[t, node]
                    right = binned[r[0]][s["feature"]] > s["cut"]
                    node, value = 2 * node + right, s["right"] if right else s["left"]
                values.append(value)
            assert guesses[seed, r[0]] == pytest.approx(np.mean(values))
    weights = defaultdict(float)
    for r in forests.importances(splits, FEATURES, 3).collect():
        weights[r["seed"]] += r["importance"]
    assert weights == pytest.approx({0: 1.0, 1: 1.0})


def test_forests_find_what_matters(spark):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(size=3))) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, c, 3 * a + 0.1 * c) for i, a, b, c in data], "id long, a double, b double, c double, y double")
    weights, rho = forests.repeated_forests(df, "id", FEATURES, "y", repeats=20, trees=5)
    got = {r["feature"]: r["importance"] for r in weights.collect()}
    assert max(got, key=got.get) == "a" and sum(got.values()) == pytest.approx(1.0)
    assert rho.collect()[0]["min"] > 0.5


# Buckets


def nearest(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def points(spark, n, dims, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    names = [f"f{i}" for i in range(dims)]
    return x, names, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names))


def test_bucket_neighbours_are_exact_in_one_bucket(spark):
    x, names, df = points(spark, 200, 6)
    got = {r["id"]: [n["neighbour"] for n in r["near"]] for r in smote.bucket_neighbours(df, "id", names, 4).collect()}
    assert got == {i: row.tolist() for i, row in enumerate(nearest(x, 4))}


def test_smote_neighbours_misses_none(spark, monkeypatch):
    """A class of more rows than a bucket, without clusters: every neighbour is a near tie."""
    x = np.random.default_rng(3).normal(size=(2500, 64)).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, 7, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    monkeypatch.setattr(learning, "load", lambda *_: rows)
    got = {(r["id"], r["k"]): r["neighbour"] for r in learning.smote_neighbours(spark, "").collect()}
    d = ((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): j for i, row in enumerate(np.argsort(d, axis=1)[:, :5]) for k, j in enumerate(row)}


def test_bucket_neighbours_recall_and_linear_work(spark):
    sent = {}
    for n in (1500, 3000):
        x, names, df = points(spark, n, 6, n)
        data = df.select("id", F.array(*names).alias("x"))
        rows = smote.in_buckets(data, 6, bucket_rows=256, tables=8).groupBy("t", "bucket").count().collect()
        sent[n] = sum(r["count"] for r in rows)
        assert max(r["count"] for r in rows) <= 256
        got = {r["id"]: {m["neighbour"] for m in r["near"]} for r in smote.bucket_neighbours(df, "id", names, 5, bucket_rows=256).collect()}
        hits = sum(len(got[i] & set(row.tolist())) for i, row in enumerate(nearest(x, 5)))
        assert hits / (5 * n) >= 0.9
    assert sent == {1500: 1500 * 16, 3000: 3000 * 16}


def test_equal_rows_do_not_fill_a_bucket(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 900 else float(i), 2.0) for i in range(1000)], "id long, a double, b double")
    data = df.select("id", F.array("a", "b").alias("x"))
    assert smote.in_buckets(data, 2, bucket_rows=64, tables=2).groupBy("t", "bucket").count().agg(F.max("count")).first()[0] <= 64
    near = {r["id"]: r["near"] for r in smote.bucket_neighbours(df, "id", ["a", "b"], 3, bucket_rows=64, tables=2).collect()}
    assert len(near) == 1000 and all(n["distance"] == 0 for i in range(900) for n in near[i])
    with pytest.raises(ValueError):
        smote.smote(df.withColumn("y", F.col("id") % 3), "y", "id", ["a"], search="all")


# Label trees


def test_children_train_where_their_ancestors_lead(spark):
    nodes = [hierarchy.Node("top", "l0", "yes"), hierarchy.Node("mid", "l1", "a", "top", "Yes"), hierarchy.Node("leaf", "l2", "x", "mid", "A")]
    rows = [(0, "YES", "a", "x"), (1, "yes", "b", "x"), (2, "no", "a", "x"), (3, None, "a", "x"), (4, "yes", "A", None), (5, "yes", None, "x")]
    df = spark.createDataFrame(rows, "id long, l0 string, l1 string, l2 string")
    kept = {n.name: {r["id"] for r in df.filter(hierarchy.trains(nodes, n)).collect()} for n in nodes}
    assert kept == {"top": {0, 1, 2, 4, 5}, "mid": {0, 1, 4}, "leaf": {0}}
    with pytest.raises(KeyError):
        hierarchy.line([hierarchy.Node("a", "l", "x", "b", "y")], "a")
    with pytest.raises(ValueError):
        hierarchy.line([hierarchy.Node("a", "l", "x", "b", "y"), hierarchy.Node("b", "l", "x", "a", "y")], "a")


def test_tree_scores_carry_up(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v), "yes" if v > 0 else "no", "a" if v > 0.7 else "b", i % 2) for i, v in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "id long, f double, l0 string, l1 string, fold int")
    nodes = [hierarchy.Node("top", "l0", "yes"), hierarchy.Node("mid", "l1", "a", "top", "yes")]
    for scorer in (hierarchy.least_squares(["f"]), hierarchy.classifier("LogisticRegression", ["f"], {"max_iter": 20})):
        out = hierarchy.fit_tree(df, nodes, "fold", [0, 1], scorer).collect()
        assert len(out) == 120
        for r in out:
            assert r["top"] == r["top_own"] and r["f"] == rows[r["id"]][1]
            assert r["mid"] == pytest.approx(r["mid_own"] * r["top_own"] + 0.5 * (1 - r["mid_own"]) * r["top_own"])
        high = np.mean([r["mid"] for r in out if r["f"] > 1])
        assert high > np.mean([r["mid"] for r in out if r["f"] < 0]) + 0.2
        hard = {r["id"]: r for r in hierarchy.fit_tree(df, nodes, "fold", [0, 1], scorer, hard=True).collect()}
        for r in out:
            n = round(r["top_own"])
            assert hard[r["id"]]["mid"] == pytest.approx(r["mid_own"] * n + 0.5 * (1 - r["mid_own"]) * n)


# Blocks


def test_union_of_blocks_keeps_rows_and_names(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, None, 5.0), (3, 0.0, 0.0)], "id long, p double, q double")
    words = spark.createDataFrame([(1, "u", 0.5), (1, "v", 1.5), (2, "v", 2.0), (9, "u", 1.0)], "id long, term string, weight double")
    terms = blocks.vocabulary(words)
    rows, names = blocks.union_blocks(df, "id", {
        "n": (blocks.dense_cells(df, "id", ["p", "q"]), blocks.named_columns(["p", "q"], df)),
        "t": (blocks.text_cells(words, "id", terms), terms.select("index", F.col("term").alias("name"))),
        "s": (blocks.dense_cells(df, "id", ["q"]), blocks.named_columns(["q"], df)),
    })
    assert {r["index"]: (r["block"], r["name"]) for r in names.collect()} == {0: ("n", "p"), 1: ("n", "q"), 2: ("t", "u"), 3: ("t", "v"), 4: ("s", "q")}
    got = {r["id"]: [tuple(c) for c in r["cells"]] for r in rows.collect()}
    assert got == {1: [(0, 2.0), (2, 0.5), (3, 1.5)], 2: [(1, 5.0), (3, 2.0), (4, 5.0)], 3: []}
    wide = {r["id"]: r["d"] for r in rows.select("id", blocks.dense(F.col("cells"), 5).alias("d")).collect()}
    assert wide[2] == [0.0, 5.0, 0.0, 2.0, 5.0]


def test_text_windows_hold_the_last_steps(spark, both_forms):
    rows = [(g * 100 + i, f"g{g}" if g else None, i, ["red", "red blue", "", None, "green"][(i + g) % 5]) for g in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, g string, t int, text string")
    cells = {r["id"]: r for r in df.collect()}
    weights = tfidf(df, "id", "text", min_df=1)
    terms = blocks.vocabulary(weights)
    numbered = {r["term"]: r["index"] for r in terms.collect()}
    assert numbered == {"blue": 0, "green": 1, "red": 2}
    own = defaultdict(list)
    for r in weights.collect():
        own[r["id"]].append((numbered[r["term"]], r["weight"]))
    out = blocks.text_windows(df, "id", ["g"], ["t"], blocks.text_cells(weights, "id", terms), 3).collect()
    assert len(out) == len(rows)
    for r in out:
        first = cells[r["id"]]["t"]
        for step, held in enumerate(r["steps"]):
            at = r["id"] - (2 - step)
            want = sorted(own[at]) if first - (2 - step) >= 0 else []
            assert [tuple(c) for c in held] == want
    assert blocks.step_rows(spark.createDataFrame(out), "id").count() == sum(len(s) for r in out for s in r["steps"])


def test_sequences_of_other_lengths_are_refused(spark):
    df = spark.createDataFrame([([[1.0], [2.0]], [[3.0], [4.0]])], "a array<array<double>>, b array<array<double>>")
    assert blocks.union_steps(df, ["a", "b"]).collect()[0]["steps"] == [[1.0, 3.0], [2.0, 4.0]]
    with pytest.raises(Exception, match="number of steps"):
        blocks.union_steps(df.withColumn("b", F.slice("b", 1, 1)), ["a", "b"]).collect()


# Distributions, external rows, transformers, names


def test_t_probabilities_as_columns(spark):
    cases = [(t, d) for t in (0.0, 0.001, -0.5, 1.0, 2.3, 6.0, 40.0) for d in (1.0, 2.0, 2.7, 5.0, 30.0, 999.0, 250_000.0)]
    df = spark.createDataFrame(cases, "t double, d double")
    for r in df.select("t", "d", student_t_p("t", "d").alias("p")).collect():
        want = t_tail(np.array([r["t"]]), np.array([r["d"]]))[0]
        assert r["p"] == pytest.approx(want, rel=1e-8, abs=1e-300)
    table = {1.0: 12.706205, 2.0: 4.302653, 10.0: 2.228139, 100.0: 1.983972, 1e6: 1.959966}
    dofs = spark.createDataFrame([(d,) for d in table], "d double")
    for r in dofs.select("d", student_t_quantile(F.lit(0.95), F.col("d")).alias("q")).collect():
        assert r["q"] == pytest.approx(table[r["d"]], abs=1e-6)
    odd = spark.createDataFrame([(float("inf"), 3.0), (float("nan"), 3.0), (1.0, 0.0), (None, 1.0)], "t double, d double")
    assert [r[0] for r in odd.select(student_t_p("t", "d")).collect()] == [0.0, None, None, None]


def test_external_rows_are_scored_as_by_each_model(lines, monkeypatch):
    df = lines.filter("y is not null").withColumn("cls", (F.col("y") > 15).cast("int"))
    run = L.cross_validate(df, "fold", [1, 2, 3, 4], "id", "cls", L.preparation(FEATURES), "LogisticRegression", {"max_iter": 15}, classes=["no", "yes"])
    for per_pass in (16, 3):
        monkeypatch.setattr(L, "MODELS_PER_PASS", per_pass)
        got = {(r["id"], r["fold"]): (r["Predicted_value"], r["yes_probability"]) for r in L.score_external(df, run.models, "id", ["no", "yes"]).collect()}
        for k, model in run.models.items():
            for r in model.transform(df).select("id", "prediction", "probability").collect():
                assert got[r["id"], k] == (r["prediction"], pytest.approx(r["probability"][1]))
        assert len(got) == 4 * df.count()
    rows, scores, counts = L.external_report(df, run.models, "id", "cls", ["accuracy"], ["no", "yes"])
    right = sum(r["n"] for r in counts.collect() if r["truth"] == r["pred"])
    assert scores.first()["accuracy"] == pytest.approx(right / df.count()) and rows.filter("folds = 4").count() == df.count()


def test_class_auc_by_name(spark):
    rows = [(i % 3, [0.6, 0.3, 0.1] if i % 5 else [0.1, 0.2, 0.7]) for i in range(30)]
    df = spark.createDataFrame(rows, "y int, p array<double>")
    got = evaluate(df, "y", "p", ["roc_auc_ovr", "roc_auc_ovr_micro", "neg_roc_auc_ovr"]).first()
    aucs = []
    for c in range(3):
        pos = [p[c] for y, p in rows if y == c]
        neg = [p[c] for y, p in rows if y != c]
        aucs.append(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    assert got["roc_auc_ovr"] == pytest.approx(np.mean(aucs)) == -got["neg_roc_auc_ovr"]
