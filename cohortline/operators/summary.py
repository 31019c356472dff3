"""Subject summaries, reshaping and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.metrics import mape, smape
from cohortline.operators.rank import attach, exact_quantiles, spearman
from cohortline.operators.running import row_positions


def subject_summary(df: DataFrame, keys: Sequence[str], truth: str = "True_value", pred: str = "Predicted_value") -> DataFrame:
    """n, means, standard deviations, SMAPE, MAPE, Spearman rho and class count per group."""
    t, p = F.col(truth), F.col(pred)
    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(t).alias("true_mn"), F.avg(p).alias("pred_mn"),
        F.stddev_samp(t).alias("true_sd"), F.stddev_samp(p).alias("pred_sd"),
        smape(t, p).alias("smape"), mape(t, p).alias("mape"),
    )
    classes = df.groupBy(*keys, truth).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.count(truth).alias("n_classes"))
    rho = spearman(df, keys, truth, pred).drop("n_pairs")
    return attach(attach(plain, classes, keys), rho, keys, "left")


def agreement(df: DataFrame, keys: Sequence[str], truth: str = "True_value", pred: str = "Predicted_value") -> DataFrame:
    """The slim form of ``subject_summary``: n, means, SMAPE and rho."""
    t, p = F.col(truth), F.col(pred)
    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(t).alias("true_mn"), F.avg(p).alias("pred_mn"),
        smape(t, p).alias("smape"), mape(t, p).alias("mape"),
    )
    return attach(plain, spearman(df, keys, truth, pred).drop("n_pairs"), keys, "left")


def second_level(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of group metrics; nulls are skipped."""
    aggs = [F.count(F.lit(1)).alias("subjects")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mn"), F.stddev_samp(v).alias(f"{v}_sd")]
    return df.groupBy(*keys).agg(*aggs)


def compliance(df: DataFrame, key: str, threshold: int) -> DataFrame:
    """Rows per key, largest first, indexed from 1, with a threshold flag."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    placed = row_positions(counts.withColumn("__rank", -F.col("n")), [], ["__rank", key])
    return placed.select(key, "n", (F.col("pos") + 1).alias("idx"), (F.col("n") >= threshold).alias("compliant"))


def contingency(df: DataFrame, rows: str, columns: str, values: Sequence[object]) -> DataFrame:
    """Counts with one column per listed value."""
    return df.groupBy(rows).pivot(columns, list(values)).count().na.fill(0, [str(v) for v in values])


def wide_cast(df: DataFrame, row_key: str, name_keys: Sequence[str], names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Spread to ``value_name`` columns; ``names`` lists the expected ``key_key`` combinations.

    Listing them keeps this one job: conditional maxima instead of a pivot that
    first has to discover its columns.
    """
    name = F.concat_ws("_", *name_keys)
    cells = [F.max(F.when(name == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in names]
    return df.groupBy(row_key).agg(*cells)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], variable, value)


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Fixed-width bins centred on multiples of the width, with the share inside each group."""
    bin_ = F.floor(F.col(value) / width + 0.5).cast("long")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    full = attach(counts, totals, list(keys))
    return full.select(*keys, "bin", (F.col("bin") * width).alias("center"), "n", (F.col("n") / F.col("total")).alias("share"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whiskers (furthest value within 1.5 IQR of the box) per group."""
    doubled = df.select(*keys, F.col(value).cast("double").alias(value))
    quartiles = exact_quantiles(doubled, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    spread = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - spread, F.col("q3") + spread)
    joined = attach(doubled, quartiles, list(keys))
    return joined.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def share_above(df: DataFrame, keys: Sequence[str], value: str, baseline: DataFrame) -> DataFrame:
    """Share of values above a one-cell baseline table."""
    scalar = baseline.scalar()
    return df.groupBy(*keys).agg(
        F.count(F.when(F.col(value) > scalar, 1)).alias("n_above"),
        F.count(F.lit(1)).alias("n"),
        (F.count(F.when(F.col(value) > scalar, 1)) / F.count(F.lit(1))).alias("share"),
    )


def collapse_duplicates(df: DataFrame, name: str, weight: str) -> DataFrame:
    return df.groupBy(name).agg(F.sum(weight).alias(weight))


def fold_mean_with_zeros(df: DataFrame, keys: Sequence[str], value: str, folds: int, name: str = "mean") -> DataFrame:
    """Mean over folds of values that are missing (= 0) in some folds.

    A sum over the long table divided by the number of folds equals the k-way
    full outer join with zeros filled in.
    """
    return df.groupBy(*keys).agg((F.sum(value) / F.lit(float(folds))).alias(name))


def weight_share(df: DataFrame, name: str, weight: str, signed: bool = False) -> DataFrame:
    """Normalised absolute weights, largest first."""
    total = df.agg(F.sum(F.abs(F.col(weight))).alias("t")).scalar()
    base = F.col(weight) if signed else F.abs(F.col(weight))
    shares = df.select(name, (base / total).alias("share"))
    placed = row_positions(shares.withColumn("__rank", -F.abs("share")), [], ["__rank", name])
    return placed.select(name, "share", (F.col("pos") + 1).alias("rank"))


def top_k(df: DataFrame, order: Sequence[str], k: int, descending: bool = True) -> DataFrame:
    direction = [F.col(order[0]).desc() if descending else F.col(order[0]), *[F.col(c) for c in order[1:]]]
    return df.orderBy(*direction).limit(k)


def best_per_group(df: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[str], better: str = "max") -> DataFrame:
    """The row with the best metric of each group, decided on the map side."""
    rest = [c for c in df.columns if c not in keys]
    score = -F.col(metric) if better == "max" else F.col(metric)
    ranked = F.struct(score.isNull().alias("n"), score.alias("s"), *tie)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("r")).select(*keys, "r.*").select(*df.columns)


def reference_means(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean_val"))


def repeated_importance(runs: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Mean importance per feature over repeated runs."""
    return runs.groupBy(feature).agg(F.avg(importance).alias("importance"), F.count(F.lit(1)).alias("runs"))


def five_numbers(df: DataFrame, value: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum of one column."""
    q = exact_quantiles(df.select(F.col(value).cast("double").alias(value)), [], value, [0.0, 0.25, 0.5, 0.75, 1.0], ["min", "q1", "median", "q3", "max"])
    return q.withColumn("mean", df.agg(F.avg(value).alias("m")).scalar())


def run_grid(models: DataFrame, labels: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """Model x label x feature source, by exploding two short literal lists."""
    return models.withColumn("Label", F.explode(F.array(*[F.lit(v) for v in labels]))).withColumn(
        "Feature_source", F.explode(F.array(*[F.lit(v) for v in sources]))
    )
