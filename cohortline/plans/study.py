"""The study from raw observations to subject-level results, as composed operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators.baseline import with_baselines
from cohortline.operators.ensemble import product_ensemble
from cohortline.operators.folds import stratified_folds, stratified_group_folds, with_fold
from cohortline.operators.models import FoldRun, nested_cross_validate, preparation
from cohortline.operators.rows import drop_unlabelled, project
from cohortline.operators.summary import agreement, second_level
from cohortline.operators.testing import paired_t
from cohortline.operators.timezones import correct_local_times


@dataclass
class Experiment:
    """One cell of the study: a model, its grid and how its parameters are chosen."""

    model: str | Callable[..., Estimator]
    grid: Sequence[Mapping[str, object]] = ({},)
    metric: str = "spearman"
    name: str | None = None


@dataclass
class Study:
    subject: str
    row_id: str
    label: str
    features: Sequence[str]
    folds: int = 5
    bins: int = 10
    seed: int = 3748
    by_subject: bool = True
    inner_folds: int = 5
    impute: str = "mean"
    scale: str = "standardize"
    experiments: Sequence[Experiment] = field(default_factory=list)


def prepare_observations(
    df: DataFrame, study: Study, zones: DataFrame | None = None, survey_times: Sequence[str] = (), sunrise: str = "day_sunrise",
    sunset: str | None = None, zipcode: str = "zipcode", keep: Sequence[str] | None = None,
) -> DataFrame:
    """Baseline labels, local times, column list and labelled rows."""
    out = with_baselines(df, study.row_id, study.label, study.subject, study.seed)
    if zones is not None:
        out = correct_local_times(out, zones, zipcode, survey_times, sunrise, sunset)
    if keep is not None:
        out = project(out, keep)
    return drop_unlabelled(out, study.label)


def assign_folds(df: DataFrame, study: Study) -> DataFrame:
    if study.by_subject:
        folds = stratified_group_folds(df, study.subject, study.label, study.folds, bins=study.bins, seed=study.seed)
        return with_fold(df, folds, study.subject)
    folds = stratified_folds(df, study.row_id, study.label, study.folds, bins=study.bins, seed=study.seed)
    return with_fold(df, folds, study.row_id)


def run_experiments(df: DataFrame, study: Study, labels: Sequence[str], parallelism: int = 4) -> tuple[DataFrame, dict[tuple[str, str], FoldRun]]:
    """Every experiment on every label: one prediction table and the fitted folds."""
    runs: dict[tuple[str, str], FoldRun] = {}
    table = None
    for label in labels:
        for e in study.experiments:
            name = e.name or str(e.model)
            run = nested_cross_validate(
                df, "fold", range(1, study.folds + 1), study.row_id, label, preparation(study.features, study.impute, study.scale),
                e.model, list(e.grid), e.metric, study.inner_folds, study.subject if study.by_subject else None,
                study.bins, study.seed, name, parallelism=parallelism,
            )
            runs[(name, label)] = run
            table = run.predictions if table is None else table.unionByName(run.predictions)
    return table, runs


def subject_results(predictions: DataFrame, observations: DataFrame, study: Study, pair: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    """Subject metrics, their means per model and label, and tests against the shuffled labels."""
    subjects = observations.select(F.col(study.row_id).alias("id"), F.col(study.subject).alias("snapshot_id"))
    full = predictions.join(subjects, "id")
    if pair is not None:
        full = product_ensemble(full, *pair)
    per_subject = agreement(full, ["snapshot_id", "Model", "Label"])
    level = per_subject.withColumn("level", F.concat_ws("|", "Model", "Label"))
    shuffled = [f"{study.label}_shuffled", f"{study.label}_shuffledWithinSubject"]
    names = [e.name or str(e.model) for e in study.experiments]
    pairs = [(f"{m}|{study.label}", f"{m}|{s}") for m in names for s in shuffled]
    return {
        "subjects": per_subject,
        "summary": second_level(per_subject, ["Model", "Label"], ["rho", "smape"]),
        "tests": paired_t(level, "snapshot_id", "level", "rho", pairs),
    }
