"""Combining predictions of folds, models, model families and label levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.scalar import arg_max, reformat_date
from cohortline.operators.rank import attach
from cohortline.operators.rows import append_with_new_ids, copy_value_between_labels


def fold_average(df: DataFrame, keys: Sequence[str], probabilities: Sequence[str]) -> DataFrame:
    """Mean class probabilities over folds and the arg-max class (first on ties).

    Means are compared at twelve decimals, so summation order cannot decide a tie.
    """
    averaged = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in probabilities], F.count(F.lit(1)).alias("folds"))
    return averaged.withColumn("predicted", arg_max(F.array(*[F.round(c, 12) for c in probabilities])))


def product_ensemble(
    df: DataFrame,
    first: str,
    second: str,
    keys: Sequence[str] = ("id", "Label"),
    model: str = "Model",
    value: str = "Predicted_value",
    name: str = "RFLR",
    combine: str = "product_half",
) -> DataFrame:
    """Add an ensemble of two models paired by row key (not by position).

    ``product_half`` is (a * b) / 2, ``mean`` is (a + b) / 2.
    """
    other = df.filter(F.col(model) == second).select(*keys, F.col(value).alias("__other"))
    paired = df.filter(F.col(model) == first).join(other, list(keys))
    joint = F.col(value) * F.col("__other") if combine == "product_half" else F.col(value) + F.col("__other")
    rows = paired.withColumn(value, joint / 2).withColumn(model, F.lit(name)).select(*df.columns)
    return df.unionByName(rows)


def with_baseline_ensembles(
    df: DataFrame, first: str, second: str, label: str, shuffled: str, keys: Sequence[str] = ("id",), combine: str = "product_half"
) -> DataFrame:
    """Ensemble for the label and its shuffled twin, then true labels copied back onto shuffled rows."""
    wanted = F.col("Label").isin(label, shuffled)
    ensembles = product_ensemble(df.filter(wanted), first, second, [*keys, "Label"], combine=combine).filter("Model = 'RFLR'")
    return copy_value_between_labels(df.unionByName(ensembles), ["Model", *keys], "Label", "True_value", label, shuffled)


def restore_order(folds: DataFrame, predictions: DataFrame) -> DataFrame:
    """Bring fold-wise prediction files (``fold, position, value``) back to row ids.

    ``folds`` is the long fold table ``(row_id, fold, split, position)``.
    """
    test = folds.filter(F.col("split") == "test").select("row_id", "fold", "position")
    return test.join(predictions, ["fold", "position"])


def append_family(
    base: DataFrame, family: DataFrame, order: Sequence[str], date: str | None = None, date_format: str = "M/d/yyyy"
) -> DataFrame:
    """Append another model family with new ids; missing columns become NULL."""
    if date is not None:
        family = family.withColumn(date, reformat_date(F.col(date), date_format))
    return append_with_new_ids(base, family, order)


def stacked_feature(df: DataFrame, predictions: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """An earlier model's prediction as a feature column.

    Checks inside the job that the prediction key is unique, so the join cannot
    change the row count.
    """
    unique = predictions.groupBy(key).agg(F.max(column).alias(name), F.count(F.lit(1)).alias("__n"))
    checked = unique.withColumn(
        name, F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate prediction key")).cast("double")).otherwise(F.col(name))
    )
    return attach(df, checked.select(key, name), [key], "left")


def up_the_tree(child: Column, parents: Sequence[Column], hard: bool = False, half_even: bool = False) -> Column:
    """Combine a child's probability with its ancestors': ``c*n + 0.5*(1-c)*n`` per level.

    ``hard`` rounds the ancestors' probabilities first; one half goes up, or to 0 with ``half_even``.
    """
    out = child
    for p in parents:
        n = (F.bround(p) if half_even else F.round(p)) if hard else p
        out = out * n + (F.lit(1.0) - out) * n * 0.5
    return out


def child_training_rows(df: DataFrame, parent_label: str, parent_value: str) -> DataFrame:
    """Rows on which a child model is trained: the parent label matches."""
    return df.filter(F.lower(F.col(parent_label)) == parent_value.lower())


def results_with_parameters(results: DataFrame, parameters: DataFrame, key: str = "fold") -> DataFrame:
    return results.join(parameters, key)


def tagged(df: DataFrame, tags: Mapping[str, DataFrame]) -> DataFrame:
    """Attach one-cell tables (counts and the like) to every row."""
    return df.withColumns({name: table.scalar() for name, table in tags.items()})
