"""Models, fold-wise fitting, tuning, importances and model files on Spark ML.

The driver only loops over folds and parameter sets; every fit, prediction and
score is a distributed job. Tables read repeatedly are persisted while fitting
and released afterwards.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasElasticNetParam, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRegParam
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators import forests, moments
from cohortline.operators.ensemble import fold_average
from cohortline.operators.folds import k_folds, stratified_group_folds
from cohortline.operators.metrics import evaluate, get_metric
from cohortline.operators.prep import TrainImputer, TrainScaler, undersample
from cohortline.operators.rank import attach
from cohortline.operators.rows import hash_order
from cohortline.operators.running import settle, spread
from cohortline.operators.summary import five_numbers, repeated_importance

MAX_TREE_DEPTH = 30
FEATURES = "features"

_RENAMED = {
    "alpha": "regParam", "l1_ratio": "elasticNetParam", "n_estimators": "numTrees", "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode", "max_iter": "maxIter", "random_state": "seed", "smoothing": "smoothing",
}

class ElasticNet(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRegParam, HasElasticNetParam, DefaultParamsReadable, DefaultParamsWritable):
    """Least squares with ``1/(2n) |y - Xb|^2 + alpha * (r |b|_1 + (1 - r)/2 |b|^2)``.

    Spark divides the label by its standard deviation first, which shrinks the
    squared penalty by that factor. The two parameters are converted so that
    the objective above holds; the fitted model is Spark's own.
    """

    @keyword_only
    def __init__(self, *, regParam=1.0, elasticNetParam=0.5):
        super().__init__()
        self._setDefault(regParam=1.0, elasticNetParam=0.5)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        label = self.getLabelCol()
        spread_of_label = dataset.agg(F.stddev_pop(label)).first()[0] or 1.0
        first = self.getRegParam() * self.getElasticNetParam()
        second = self.getRegParam() * (1.0 - self.getElasticNetParam()) * spread_of_label
        total = first + second
        regression = LinearRegression(
            featuresCol=self.getFeaturesCol(), labelCol=label, predictionCol=self.getPredictionCol(), standardization=False,
            regParam=total, elasticNetParam=first / total if total > 0 else 0.0, maxIter=1000, tol=1e-10,
        )
        return regression.fit(dataset)


_FACTORIES: dict[str, Callable[[], Estimator]] = {
    "ElasticNet": lambda: ElasticNet(),
    "LinearRegression": lambda: LinearRegression(solver="normal", regParam=0.0),
    "RandomForestRegressor": lambda: RandomForestRegressor(seed=17),
    "RandomForestClassifier": lambda: RandomForestClassifier(seed=17),
    "GradientBoostingRegressor": lambda: GBTRegressor(seed=17, maxIter=20),
    "GradientBoostingClassifier": lambda: GBTClassifier(seed=17, maxIter=20),
    "DecisionTreeRegressor": lambda: DecisionTreeRegressor(seed=17),
    "DecisionTreeClassifier": lambda: DecisionTreeClassifier(seed=17),
    "LogisticRegression": lambda: LogisticRegression(),
    "MultinomialNB": lambda: NaiveBayes(modelType="multinomial"),
    "LinearSVC": lambda: LinearSVC(),
}


def make_estimator(model: str | Callable[..., Estimator], label: str, params: Mapping[str, object] | None = None) -> Estimator:
    """An estimator by name, or from a user factory ``f(**params)``.

    Parameter names of the usual Python libraries are accepted. A missing depth
    becomes 30, the deepest tree Spark ML grows; a larger one is refused.
    """
    params = dict(params or {})
    if callable(model):
        estimator = model(**params)
    else:
        if model not in _FACTORIES:
            raise KeyError(f"unknown model {model!r}; one of {', '.join(_FACTORIES)}")
        estimator = _FACTORIES[model]()
        if "max_depth" in params:
            params["max_depth"] = params["max_depth"] or MAX_TREE_DEPTH
            if params["max_depth"] > MAX_TREE_DEPTH:
                raise ValueError(f"trees are at most {MAX_TREE_DEPTH} deep, not {params['max_depth']}; None asks for that depth")
        estimator._set(**{_RENAMED.get(k, k): v for k, v in params.items()})
    return estimator._set(featuresCol=FEATURES, labelCol=label)


def text_block(column: str, out: str, cap: int, min_df: float = 1.0, use_idf: bool = True) -> list[Estimator]:
    """Pipeline stages from a word-array column to (TF-IDF) vectors."""
    counts = CountVectorizer(inputCol=column, outputCol=f"{out}_tf" if use_idf else out, minDF=min_df, vocabSize=cap)
    if not use_idf:
        return [counts]
    return [counts, IDF(inputCol=f"{out}_tf", outputCol=f"{out}_idf"), Normalizer(inputCol=f"{out}_idf", outputCol=out)]


def selection_stage(kind: str, label: str, out: str = "selected", **params: object) -> Estimator:
    """Feature-selection slot: variance threshold or univariate tests."""
    if kind == "variance":
        return VarianceThresholdSelector(featuresCol=FEATURES, outputCol=out, **params)
    selector = UnivariateFeatureSelector(featuresCol=FEATURES, outputCol=out, labelCol=label)
    return selector.setFeatureType(params.get("feature_type", "continuous")).setLabelType(params.get("label_type", "continuous"))


def preparation(
    features: Sequence[str], impute: str | None = "mean", scale: str | None = "standardize", extra: Sequence[str] = ()
) -> list[Estimator]:
    """Impute, scale and assemble; statistics come from whatever rows the pipeline is fitted on."""
    stages: list[Estimator] = []
    if impute:
        stages.append(TrainImputer(inputCols=list(features), strategy=impute))
    if scale:
        stages.append(TrainScaler(inputCols=list(features), strategy=scale))
    return [*stages, VectorAssembler(inputCols=[*features, *extra], outputCol=FEATURES, handleInvalid="keep")]


class MetricEvaluator(Evaluator):
    """Any registered metric as a Spark ML evaluator (for ``CrossValidator``)."""

    def __init__(self, metric: str, label: str, prediction: str = "prediction"):
        super().__init__()
        self.metric, self.label, self.prediction = metric, label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        value = evaluate(dataset, self.label, self.prediction, [self.metric]).first()[self.metric]
        return float("nan") if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return get_metric(self.metric).better == "max"


def parameter_grid(space: Mapping[str, Sequence[object]] | Sequence[Mapping[str, Sequence[object]]]) -> list[dict[str, object]]:
    """Cartesian product per space; several spaces (alternatives) are chained."""
    spaces = [space] if isinstance(space, Mapping) else list(space)
    out = []
    for s in spaces:
        names = sorted(s)
        out += [dict(zip(names, values)) for values in itertools.product(*(s[n] for n in names))]
    return out


@dataclass
class FoldRun:
    """Out-of-fold predictions, the fitted model of every fold and the scores seen while tuning."""

    predictions: DataFrame
    models: dict[int, PipelineModel]
    tuning: list[dict[str, object]] = field(default_factory=list)


def prediction_rows(
    scored: DataFrame, row_id: str, label: str, model: str, source: str = "RegularFeatureInput",
    classes: Sequence[str] = (), extra: Sequence[str] = (),
) -> DataFrame:
    """The fixed prediction layout; classification adds ``<class>_probability``."""
    cells = [
        F.col(row_id).alias("id"), F.lit(model).alias("Model"), F.lit(label).alias("Label"), F.lit(source).alias("Feature_source"),
        F.col(label).cast("double").alias("True_value"), F.col("prediction").alias("Predicted_value"),
    ]
    if classes and "probability" in scored.columns:
        p = vector_to_array("probability")
        cells += [F.get(p, F.lit(i)).alias(f"{c}_probability") for i, c in enumerate(classes)]
    return scored.select(*cells, *extra)


def _predict_rows(model: Model, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    if "probability" not in scored.columns and "rawPrediction" in scored.columns:
        scored = scored.withColumnRenamed("rawPrediction", "decision")
    return scored


def cross_validate(
    df: DataFrame,
    fold: str,
    folds: Sequence[int],
    row_id: str,
    label: str,
    stages: Sequence[Estimator],
    model: str | Callable[..., Estimator],
    params: Mapping[str, object] | Mapping[int, Mapping[str, object]] | None = None,
    name: str | None = None,
    classes: Sequence[str] = (),
    prepare_train: Callable[[DataFrame], DataFrame] | None = None,
    parallelism: int = 4,
) -> FoldRun:
    """Fit on ``fold <> k``, predict ``fold = k``; each labelled row is predicted once.

    ``prepare_train`` changes the training rows only (resampling, shuffled
    labels). ``params`` may differ per fold when keyed by fold number.
    """
    name = name or (model if isinstance(model, str) else getattr(model, "__name__", "model"))
    data = spread(df.filter(F.col(label).isNotNull())).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(k: int) -> PipelineModel:
        train = data.filter(F.col(fold) != k)
        if prepare_train is not None:
            train = prepare_train(train)
        chosen = params[k] if params and k in params else params
        return Pipeline(stages=[*stages, make_estimator(model, label, chosen)]).fit(train)

    try:
        models = dict(zip(folds, _in_parallel(df, fit, folds, parallelism)))
    finally:
        data.unpersist()
    source = df.filter(F.col(label).isNotNull())
    out = None
    for k in folds:
        scored = _predict_rows(models[k], source.filter(F.col(fold) == k))
        rows = prediction_rows(scored, row_id, label, name, classes=classes, extra=[fold])
        out = rows if out is None else out.unionByName(rows)
    return FoldRun(out, models)


#: Values in a partition of rows that are fitted on many times over, and the partitions that small tables keep.
CELLS_PER_PART, LEAST_PARTS = 1 << 17, 8


def _held_by_size(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows persisted for many small jobs, and their partitions: spread, but over no more than they fill."""
    held = spread(df).persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(LEAST_PARTS, -(-held.count() * len(held.columns) // CELLS_PER_PART))
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if parts >= most:
        return held, most
    fewer = held.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    fewer.count()
    held.unpersist()
    return fewer, parts


def cross_validate_each(
    df: DataFrame,
    fold: str,
    folds: Sequence[int],
    row_id: str,
    label: str,
    stages: Sequence[Estimator],
    models: Mapping[str, Mapping[str, object] | None],
    classes: Sequence[str] = (),
    parallelism: int = 4,
) -> dict[str, FoldRun]:
    """``cross_validate`` for several models by name: a fold's preparation is fitted once and its prepared rows serve all of them.

    Models of all folds are fitted side by side; a fold's test rows are prepared
    once and scored by all of its models in one pass.
    """
    data, parts = _held_by_size(df.filter(F.col(label).isNotNull()))
    ready: dict[int, DataFrame] = {}

    def prepare(k: int) -> PipelineModel:
        train = data.filter(F.col(fold) != k)
        prepared = Pipeline(stages=list(stages)).fit(train)
        ready[k] = prepared.transform(train).select(label, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
        return prepared

    def fit(job: tuple[int, str]) -> Model:
        k, m = job
        return make_estimator(m, label, models[m]).fit(ready[k])

    jobs = [(k, m) for m in models for k in folds]
    try:
        prepared = dict(zip(folds, _in_parallel(df, prepare, folds, parallelism)))
        fitted = dict(zip(jobs, _in_parallel(df, fit, jobs, parallelism)))
        scored = None
        for k in folds:
            test = prepared[k].transform(data.filter(F.col(fold) == k)).select(row_id, label, fold, FEATURES)
            part, made = _scored_by_each(test, {m: fitted[k, m] for m in models}, bool(classes))
            scored = part if scored is None else scored.unionByName(part)
        scored = settle(scored.repartition(parts))  # read by every model's rows
    finally:
        for rows in (data, *ready.values()):
            rows.unpersist()
    out = {}
    for m in models:
        cells = [F.col(m)["p"].alias("prediction"), *([F.col(m)["q"].alias("probability")] if m in made else [])]
        rows = prediction_rows(scored.select(row_id, label, fold, *cells), row_id, label, m, classes=classes, extra=[fold])
        out[m] = FoldRun(rows, {k: PipelineModel([*prepared[k].stages, fitted[k, m]]) for k in folds})
    return out


def _scored_by_each(rows: DataFrame, models: Mapping[str, Model], probabilities: bool) -> tuple[DataFrame, list[str]]:
    """Rows with a struct by model (``p``: its prediction, ``q``: its probabilities) instead of features, and the models that have ``q``."""
    keep, cells, made = [c for c in rows.columns if c != FEATURES], [], []
    for i, (m, fitted) in enumerate(models.items()):
        fitted = fitted.copy()
        own = {"predictionCol": f"__p{i}", "probabilityCol": f"__q{i}", "rawPredictionCol": f"__r{i}"}
        fitted._set(**{k: v for k, v in own.items() if fitted.hasParam(k)})
        rows = fitted.transform(rows)
        if probabilities and f"__q{i}" in rows.columns:
            made.append(m)
        cells.append(F.struct(F.col(f"__p{i}").alias("p"), *([F.col(f"__q{i}").alias("q")] if m in made else [])).alias(m))
    return rows.select(*keep, *cells), made


def _in_parallel(df: DataFrame, fn: Callable, items: Sequence, parallelism: int) -> list:
    if parallelism <= 1 or len(items) <= 1:
        return [fn(i) for i in items]
    run = inheritable_thread_target(df.sparkSession)(fn)
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(run, items))


def score_side_by_side(rows: DataFrame, models: Mapping[int, Model], keep: Sequence[str], score: bool = False) -> DataFrame:
    """Predictions of many models of one kind in one pass: ``(keep..., set, p)``.

    Every model writes its own column, so the rows are read once however many
    models there are. ``score`` returns the positive class's probability.
    """
    out = rows
    for i, fitted in models.items():
        fitted = fitted.copy()
        renames = {"predictionCol": f"__p{i}", "probabilityCol": f"__q{i}", "rawPredictionCol": f"__r{i}"}
        fitted._set(**{k: v for k, v in renames.items() if fitted.hasParam(k)})
        out = fitted.transform(out)

    def guess(i: int) -> Column:
        for made in (f"__q{i}", f"__r{i}") if score else ():  # without probabilities, decision values rank just as well
            if made in out.columns:
                return F.get(vector_to_array(made), F.lit(1))
        return F.col(f"__p{i}")

    cells = F.array(*[F.struct(F.lit(i).alias("set"), guess(i).alias("p")) for i in models])
    return out.select(*keep, F.inline(cells))


_SCORE_METRICS = ("roc_auc", "average_precision", "binary_crossentropy")


def tune(
    train: DataFrame,
    inner_fold: str,
    inner_folds: Sequence[int],
    label: str,
    stages: Sequence[Estimator],
    model: str | Callable[..., Estimator],
    grid: Sequence[Mapping[str, object]],
    metric: str,
    parallelism: int = 4,
) -> tuple[dict[str, object], list[dict[str, object]]]:
    """Best parameters by the mean inner-fold score; one combination skips the search.

    Preparation is fitted once per inner fold and shared by all parameter sets,
    the test rows of an inner fold are scored by all of them in one pass, and
    one job computes the scores of all (inner fold, parameter set) pairs.
    """
    if len(grid) == 1:
        return dict(grid[0]), []
    data = train.filter(F.col(label).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _searched(data, label, list(inner_folds), inner_fold, stages, model, grid, metric, parallelism)
    finally:
        data.unpersist()


def _searched(
    data: DataFrame, label: str, inner_folds: Sequence[int], inner_fold: str, stages: Sequence[Estimator],
    model: str | Callable[..., Estimator], grid: Sequence[Mapping[str, object]], metric: str, parallelism: int,
) -> tuple[dict[str, object], list[dict[str, object]]]:

    def ready(j: int) -> DataFrame:
        prepared = Pipeline(stages=list(stages)).fit(data.filter(F.col(inner_fold) != j)).transform(data)
        return prepared.select(F.col(label), F.col(inner_fold).alias("inner"), FEATURES)

    tables = dict(zip(inner_folds, _in_parallel(data, ready, inner_folds, parallelism)))
    jobs = [(j, i) for j in inner_folds for i in range(len(grid))]

    def fit(job: tuple[int, int]) -> Model:
        j, i = job
        return make_estimator(model, label, grid[i]).fit(tables[j].filter(F.col("inner") != j))

    fitted = dict(zip(jobs, _in_parallel(data, fit, jobs, parallelism)))
    every = None
    for j in inner_folds:
        own = {i: fitted[(j, i)] for i in range(len(grid))}
        part = score_side_by_side(tables[j].filter(F.col("inner") == j), own, [label, "inner"], metric in _SCORE_METRICS)
        every = part if every is None else every.unionByName(part)
    scores: dict[int, list[float]] = {i: [] for i in range(len(grid))}
    for row in evaluate(every, label, "p", [metric], ["set", "inner"]).collect():
        if row[metric] is not None:
            scores[row["set"]].append(row[metric])
    table = [{"params": dict(grid[i]), "score": sum(v) / len(v) if v else None} for i, v in scores.items()]
    return pick_best(table, get_metric(metric).better), table


def pick_best(table: Sequence[Mapping[str, object]], better: str) -> dict[str, object]:
    """First parameter set with the best mean score; sets without a score lose."""
    known = [row for row in table if row["score"] is not None]
    if not known:
        return dict(table[0]["params"])
    chosen = max(known, key=lambda r: r["score"]) if better == "max" else min(known, key=lambda r: r["score"])
    return dict(chosen["params"])


def nested_cross_validate(
    df: DataFrame,
    fold: str,
    folds: Sequence[int],
    row_id: str,
    label: str,
    stages: Sequence[Estimator],
    model: str | Callable[..., Estimator],
    grid: Sequence[Mapping[str, object]],
    metric: str,
    inner_k: int = 5,
    group: str | None = None,
    inner_bins: int = 10,
    seed: int = 3748,
    name: str | None = None,
    classes: Sequence[str] = (),
    parallelism: int = 4,
    from_sums: Sequence[str] | None = None,
) -> FoldRun:
    """Grid search inside every outer training set, then refit with the best parameters.

    Inner folds keep groups whole when ``group`` is given. ``from_sums`` names the
    features of an elastic net with the usual preparation (mean, standardised): its
    fits then come from sums of products of one pass, and ``models`` stays empty.
    """
    folds = list(folds)
    if from_sums is not None:
        return _nested_from_sums(df, fold, folds, row_id, label, model, grid, metric, inner_k, group, inner_bins, seed, name, from_sums)

    def search(k: int) -> tuple[dict[str, object], list[dict[str, object]]]:
        train = df.filter((F.col(fold) != k) & F.col(label).isNotNull())
        if len(grid) > 1:
            if group is not None:
                inner = stratified_group_folds(train, group, label, inner_k, bins=inner_bins, seed=seed).select(group, F.col("fold").alias("__inner"))
                train = attach(train, inner, [group])
            else:
                inner = k_folds(train, row_id, inner_k, seed=seed).withColumnRenamed("fold", "__inner")
                train = attach(train, inner, [row_id])
        return tune(train, "__inner", range(1, inner_k + 1), label, stages, model, grid, metric, parallelism)

    found = dict(zip(folds, _in_parallel(df, search, folds, parallelism)))
    best = {k: found[k][0] for k in folds}
    tuning = [{"fold": k, **row, "best": row["params"] == best[k]} for k in folds for row in found[k][1]]
    run = cross_validate(df, fold, folds, row_id, label, stages, model, best, name, classes, parallelism=parallelism)
    run.tuning = tuning
    return run


def _nested_from_sums(
    df: DataFrame, fold: str, folds: list[int], row_id: str, label: str, model: str | Callable[..., Estimator], grid: Sequence[Mapping[str, object]],
    metric: str, inner_k: int, group: str | None, inner_bins: int, seed: int, name: str | None, features: Sequence[str],
) -> FoldRun:
    if model != "ElasticNet":
        raise ValueError("only an elastic net is fitted from sums")
    if group is not None:
        rows, inner = moments.inner_group_folds(df, fold, folds, group, label, inner_k, inner_bins, seed)
    else:
        rows, inner = df, {}
        for k in folds:
            inner[k] = f"__inner{k}"
            train = df.filter((F.col(fold) != k) & F.col(label).isNotNull())
            rows = attach(rows, k_folds(train, row_id, inner_k, seed=seed).withColumnRenamed("fold", inner[k]), [row_id], "left")
    sets = [(float(p["alpha"]), float(p["l1_ratio"])) for p in grid]
    run = moments.nested_elastic_net(rows, fold, folds, row_id, label, features, inner, inner_k, sets, metric, name or model)
    found = run.tuning.orderBy("fold", "set").collect()  # folds x sets rows
    tuning = [{"fold": r["fold"], "params": dict(grid[r["set"]]), "score": r["score"], "best": r["best"]} for r in found]
    layout = ["id", "Model", "Label", F.lit("RegularFeatureInput").alias("Feature_source"), "True_value", "Predicted_value", fold]
    return FoldRun(run.predictions.select(*layout), {}, tuning)


def tuning_table(df: DataFrame, run: FoldRun) -> DataFrame:
    rows = [
        (r["fold"], {k: str(v) for k, v in r["params"].items()}, r["score"], r["best"]) for r in run.tuning
    ]
    return df.sparkSession.createDataFrame(rows, "fold int, params map<string,string>, score double, best boolean")


def importance_table(df: DataFrame, models: Mapping[int, PipelineModel], features: Sequence[str]) -> DataFrame:
    """``(fold, feature, weight)`` from importances, coefficients or log-probabilities."""
    rows = []
    for k, pipeline in models.items():
        last = pipeline.stages[-1] if isinstance(pipeline, PipelineModel) else pipeline
        if hasattr(last, "featureImportances"):
            weights = last.featureImportances.toArray()
        elif hasattr(last, "coefficients"):
            weights = last.coefficients.toArray()
        else:
            theta = last.theta.toArray()
            weights = theta[-1] - theta[0] if theta.shape[0] == 2 else theta[-1]
        rows += [(k, f, float(w)) for f, w in zip(features, weights, strict=True)]
    return df.sparkSession.createDataFrame(rows, "fold int, feature string, weight double")


#: Models that score the rows in one pass; a plan grows with them.
MODELS_PER_PASS = 16


def score_external(df: DataFrame, models: Mapping[int, PipelineModel], row_id: str, classes: Sequence[str] = ()) -> DataFrame:
    """Predict new rows with every fold's model: one row per (row, fold), ready for averaging.

    The rows are read once for up to MODELS_PER_PASS models: each model starts
    from the rows' own columns and leaves only its prediction behind.
    """
    out, numbers = None, list(models)
    for start in range(0, len(numbers), MODELS_PER_PASS):
        some = numbers[start : start + MODELS_PER_PASS]
        rows, made = df.select(F.struct("*").alias("__in")), []
        for k in some:
            scored = _predict_rows(models[k], rows.select("__in", *made, "__in.*"))
            cells = [F.lit(k).alias("fold"), F.col("prediction").alias("Predicted_value")]
            if classes and "probability" in scored.columns:
                p = vector_to_array("probability")
                cells += [F.get(p, F.lit(i)).alias(f"{c}_probability") for i, c in enumerate(classes)]
            rows = scored.select("__in", *made, F.struct(*cells).alias(f"__out{k}"))
            made.append(f"__out{k}")
        part = rows.select(F.col("__in").getField(row_id).alias("id"), F.inline(F.array(*made)))
        out = part if out is None else out.unionByName(part)
    return out


def external_report(
    df: DataFrame, models: Mapping[int, PipelineModel], row_id: str, truth: str, metrics: Sequence[str], classes: Sequence[str] = (),
    to_class: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold averages of external rows, their metrics and their confusion counts.

    With ``classes`` the averaged probabilities decide the class; otherwise predicted
    values are averaged, and ``to_class`` makes classes of truth and prediction for
    the counts.
    """
    scored = score_external(df, models, row_id, classes)
    probabilities = [f"{c}_probability" for c in classes]
    if classes:
        mean = fold_average(scored, ["id"], probabilities).withColumn("Predicted_value", F.col("predicted").cast("double"))
    else:
        mean = scored.groupBy("id").agg(F.avg("Predicted_value").alias("Predicted_value"), F.count(F.lit(1)).alias("folds"))
    known = df.select(F.col(row_id).alias("__id"), F.col(truth).cast("double").alias("True_value"))
    rows = mean.join(known, F.col("id") == F.col("__id")).select("id", "True_value", "Predicted_value", "folds", *probabilities)
    turn = to_class or (lambda c: c)
    counted = rows.filter(F.col("True_value").isNotNull()).groupBy(turn(F.col("True_value")).alias("truth"), turn(F.col("Predicted_value")).alias("pred"))
    return rows, evaluate(rows.filter("True_value is not null"), "True_value", "Predicted_value", metrics), counted.agg(F.count(F.lit(1)).alias("n"))


@dataclass
class TransformedModel:
    """A fitted model between a transformer of rows and one of predictions, both DataFrame to DataFrame."""

    model: PipelineModel
    before: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self.before(df) if self.before else df
        scored = self.model.transform(rows)
        return self.after(scored) if self.after else scored


def fit_transformed(
    train: DataFrame, stages: Sequence[Estimator], estimator: Estimator, fit_transformer: Callable[[DataFrame], DataFrame] | None = None,
    before: Callable[[DataFrame], DataFrame] | None = None, prediction_transformer: Callable[[DataFrame], DataFrame] | None = None,
) -> TransformedModel:
    """Fit on rows that ``fit_transformer`` has changed (training only); predictions pass ``prediction_transformer``."""
    rows = fit_transformer(train) if fit_transformer else train
    rows = before(rows) if before else rows
    return TransformedModel(Pipeline(stages=[*stages, estimator]).fit(rows), before, prediction_transformer)


def learning_curve(
    df: DataFrame,
    fold: str,
    folds: Sequence[int],
    row_id: str,
    label: str,
    stages: Sequence[Estimator],
    model: str | Callable[..., Estimator],
    metric: str,
    params: Mapping[str, object] | None = None,
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
    seed: int = 17,
    from_sums: Sequence[str] | None = None,
) -> DataFrame:
    """Mean and sd of the fold scores for growing training sets (nested hash samples).

    ``from_sums`` names the features of a linear regression with the usual preparation
    (mean, standardised) and the rmse: all its fits then come from sums of products of one pass.
    """
    if from_sums is not None:
        if model != "LinearRegression" or metric != "rmse" or params:
            raise ValueError("only the rmse of a linear regression comes from sums")
        return moments.linear_learning_curve(df, fold, folds, row_id, label, from_sums, sizes, seed=seed)
    unit = F.pmod(hash_order(seed, row_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = None
    for size in sizes:
        run = cross_validate(df, fold, folds, row_id, label, stages, model, params, prepare_train=lambda t, s=size: t.filter(unit < s))
        scores = evaluate(run.predictions, "True_value", "Predicted_value", [metric], [fold])
        line = scores.agg(F.avg(metric).alias("score_mean"), F.stddev_pop(metric).alias("score_sd"), F.count(metric).alias("folds"))
        line = line.select(F.lit(float(size)).alias("train_share"), "score_mean", "score_sd", "folds")
        out = line if out is None else out.unionByName(line)
    return out


def balanced_bagging(
    train: DataFrame,
    test: DataFrame,
    row_id: str,
    label: str,
    stages: Sequence[Estimator],
    model: str | Callable[..., Estimator],
    classes: Sequence[str],
    bags: int = 10,
    params: Mapping[str, object] | None = None,
    seed: int = 17,
) -> DataFrame:
    """Models on differently under-sampled training sets, probabilities averaged."""
    models = {
        b: Pipeline(stages=[*stages, make_estimator(model, label, params)]).fit(undersample(train, label, row_id, seed + b))
        for b in range(1, bags + 1)
    }
    scored = score_external(test, models, row_id, classes)
    columns = [f"{c}_probability" for c in classes]
    averaged = scored.groupBy("id").agg(*[F.avg(c).alias(c) for c in columns])
    top = F.array_position(F.array(*columns), F.array_max(F.array(*columns))) - 1
    return averaged.withColumn("Predicted_value", top.cast("double"))


def repeated_forests(df: DataFrame, features: Sequence[str], label: str, repeats: int = 1000, trees: int = 10, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Small forests with different seeds: mean importance, and the five numbers of the in-sample rho.

    The forests of all seeds grow together, one aggregation a level, so the number
    of jobs depends on the depth alone. Rows need no id: equal ones are numbered,
    so a bootstrap follows from the rows' values and not from their order.
    """
    rows = settle(df.dropna(subset=[label, *features]))
    if rows.isEmpty():
        raise ValueError("no rows without nulls to grow forests on")
    cells = [F.col(label).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(features)]]
    names = [f"__x{i}" for i in range(len(features))]
    equal = rows.select(*cells).groupBy("__y", *names).agg(F.count(F.lit(1)).alias("__n"))
    copies = spread(equal.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n"))
    numbered = forests.settle(copies.withColumn("__row", F.xxhash64("__y", *names, "__copy")).drop("__copy"))
    tried = len(features) if trees == 1 else -(-len(features) // 3)
    splits, cuts = forests.grow(numbered, "__row", "__y", names, repeats * trees, depth, tried=tried)
    own = forests.importances(splits, features, trees)
    each = df.sparkSession.range(repeats).select(F.col("id").cast("int").alias("seed"), F.explode(F.array(*[F.lit(c) for c in features])).alias("feature"))
    weights = each.join(own, ["seed", "feature"], "left").na.fill(0.0, ["importance"])  # a forest without a split has none
    guesses = forests.predict(numbered, "__row", names, splits, cuts, depth, trees).join(numbered.select("__row", "__y"), "__row")
    return repeated_importance(weights), five_numbers(evaluate(guesses, "__y", "p", ["spearman"], ["seed"]), "spearman")


def save_models(models: Mapping[int, PipelineModel], folder: str) -> None:
    for k, model in models.items():
        model.write().overwrite().save(f"{folder}/fold={k}")


def load_models(folder: str, folds: Sequence[int]) -> dict[int, PipelineModel]:
    return {k: PipelineModel.load(f"{folder}/fold={k}") for k in folds}
