"""Significance tests and regressions on subject tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.distributions import student_t_p, student_t_quantile
from cohortline.operators.rank import attach, spearman, varies


def _t_columns(n: Column, mean: Column, sd: Column) -> tuple[Column, Column, Column]:
    se = sd / F.sqrt(n.cast("double"))
    return F.try_divide(mean, se), (n - 1).cast("double"), se


def _sd(value: str) -> Column:
    """Sample sd; exactly 0 for a constant, NULL for a single value."""
    sd = F.stddev_samp(value)
    return F.when(varies(F.col(value)) | sd.isNull(), sd).otherwise(0.0)


def one_sample_t(df: DataFrame, value: str, mu: float = 0.0, keys: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """t, degrees of freedom, mean difference, 95 % interval and p; nulls dropped."""
    m = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), (F.avg(value) - F.lit(mu)).alias("mean_diff"), _sd(value).alias("sd_diff")
    )
    t, dof, se = _t_columns(F.col("n"), F.col("mean_diff"), F.col("sd_diff"))
    out = m.select(*keys, "n", "mean_diff", "sd_diff", t.alias("t"), dof.alias("df"))
    if not p_value:
        return out
    margin = student_t_quantile(F.lit(0.95), F.col("df")) * F.col("sd_diff") / F.sqrt(F.col("n").cast("double"))
    return (
        out.withColumn("p_value", student_t_p("t", "df"))
        .withColumn("__margin", margin)
        .withColumns({"ci_low": F.col("mean_diff") - F.col("__margin"), "ci_high": F.col("mean_diff") + F.col("__margin")})
        .drop("__margin")
    )


def paired_t(df: DataFrame, subject: str, variable: str, value: str, pairs: Sequence[tuple[str, str]], p_value: bool = True) -> DataFrame:
    """Paired tests between levels of ``variable``; subjects missing one side drop out.

    All pairs come from one pass: values are spread to one column per level and
    subject, and each pair contributes the moments of its difference.
    """
    levels = sorted({v for pair in pairs for v in pair})
    wide = df.groupBy(subject).agg(*[F.max(F.when(F.col(variable) == v, F.col(value))).alias(f"__{i}") for i, v in enumerate(levels)])
    at = {v: F.col(f"__{i}") for i, v in enumerate(levels)}
    rows = F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (at[a] - at[b]).alias("diff")) for a, b in pairs
    ])
    return one_sample_t(wide.select(F.inline(rows)), "diff", keys=["first", "second"], p_value=p_value)


def all_pairs(values: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1:]]


def holm(df: DataFrame, p: str = "p_value", name: str = "p_adj", tie: Sequence[str] = ("first", "second")) -> DataFrame:
    """Holm adjustment over a table of tests (one row per pair of levels, so it is tiny)."""
    ordered = Window.partitionBy(F.lit(1)).orderBy(F.col(p).asc_nulls_last(), *tie)
    m = F.count(p).over(Window.partitionBy(F.lit(1)))
    stepped = df.withColumn("__step", (m - F.row_number().over(ordered) + 1) * F.col(p))
    running = F.max("__step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(name, F.when(F.col(p).isNotNull(), F.least(running, F.lit(1.0)))).drop("__step")


def welch_t(df: DataFrame, variable: str, value: str, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Two-sample tests with unequal variances between levels of ``variable``."""
    moments = df.filter(F.col(value).isNotNull()).groupBy(*keys, variable).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    )
    levels = sorted({v for pair in pairs for v in pair})
    pick = lambda v, c: F.max(F.when(F.col(variable) == v, F.col(c)))
    wide = moments.groupBy(*keys).agg(*[pick(v, c).alias(f"__{c}{i}") for i, v in enumerate(levels) for c in "nmv"])
    idx = {v: i for i, v in enumerate(levels)}
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("first"), F.lit(b).alias("second"),
            *[F.col(f"__{c}{idx[s]}").alias(f"{c}{k}") for k, s in ((1, a), (2, b)) for c in "nmv"],
        )
        for a, b in pairs
    ])
    w = wide.select(*keys, F.inline(rows))
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    out = w.select(
        *keys, "first", "second", F.col("m1").alias("mean_first"), F.col("m2").alias("mean_second"),
        F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b)).alias("t"), dof.alias("df"),
    )
    return out.withColumn("p_value", student_t_p("t", "df")) if p_value else out


def reference_dummies(df: DataFrame, column: str, reference: str, levels: Sequence[str]) -> DataFrame:
    """0/1 columns for every level but the reference."""
    return df.withColumns(
        {f"{column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in levels if v != reference}
    )


def ols(df: DataFrame, label: str, features: Sequence[str], lost_df: int = 0) -> DataFrame:
    """Least squares with standard errors, t and p per term (normal equations in Spark ML).

    ``lost_df`` takes further degrees of freedom away, as for absorbed subject
    effects; the table then carries no intercept.
    """
    complete = df.dropna(subset=[label, *features])
    data = VectorAssembler(inputCols=list(features), outputCol="__x").transform(complete)
    absorbed = lost_df > 0
    model = LinearRegression(
        featuresCol="__x", labelCol=label, solver="normal", regParam=0.0, fitIntercept=not absorbed
    ).fit(data)
    s = model.summary
    names = list(features) + ([] if absorbed else ["(Intercept)"])
    estimates = list(model.coefficients) + ([] if absorbed else [model.intercept])
    errors = list(s.coefficientStandardErrors)
    dof = float(s.degreesOfFreedom)
    corrected = dof - lost_df
    rescale = (dof / corrected) ** 0.5
    rows = [(n, float(e), float(x) * rescale, corrected, s.r2) for n, e, x in zip(names, estimates, errors)]
    table = df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, df double, r2 double")
    return table.withColumn("t", F.try_divide("estimate", "std_error")).withColumn("p_value", student_t_p("t", "df"))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores (sample sd) of complete rows, for standardised coefficients."""
    complete = df.dropna(subset=list(columns))
    stats = complete.agg(*[F.struct(F.avg(c).alias("m"), _sd(c).alias("s")).alias(c) for c in columns])
    cells = {c: stats.select(c).scalar() for c in columns}
    return complete.withColumns({c: F.try_divide(F.col(c) - cells[c]["m"], cells[c]["s"]) for c in columns})


def demean(df: DataFrame, subject: str, columns: Sequence[str]) -> DataFrame:
    """Deviations from the subject's mean (aggregate and join back, no subject-sized task)."""
    complete = df.dropna(subset=list(columns))
    means = complete.groupBy(subject).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    joined = attach(complete, means, [subject])
    return joined.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*[f"__m_{c}" for c in columns])


def within_subject_ols(df: DataFrame, subject: str, label: str, features: Sequence[str]) -> DataFrame:
    """Fixed-effect regression: what the features explain inside subjects."""
    centred = demean(df, subject, [label, *features])
    subjects = centred.select(subject).distinct().count()
    return ols(centred, label, features, lost_df=subjects)


def within_slope(df: DataFrame, subject: str, label: str, feature: str) -> DataFrame:
    """One-covariate form of the within regression by moments, one row."""
    centred = demean(df, subject, [label, feature])
    x, y = F.col(feature), F.col(label)
    m = centred.agg(
        F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy")
    )
    subjects = centred.agg(F.count_distinct(subject).alias("g")).scalar()
    dof = F.col("n") - subjects - 1
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    sse = F.col("syy") - slope * F.col("sxy")
    se = F.sqrt(F.try_divide(F.try_divide(sse, dof.cast("double")), F.col("sxx")))
    return m.select("n", dof.alias("df"), slope.alias("slope"), se.alias("std_error"), F.try_divide(slope, se).alias("t"))


def rho_comparison(df: DataFrame, keys: Sequence[str], truth: str, rivals: dict[str, str]) -> DataFrame:
    """Spearman rho of the label against several columns, as one long table.

    ``rivals`` maps a variable name to a column; a leading ``-`` flips the
    label's sign (for measures that fall when the label rises).
    """
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("variable"),
            (-F.col(truth) if column.startswith("-") else F.col(truth)).cast("double").alias("a"),
            F.col(column.lstrip("-")).cast("double").alias("b"),
        )
        for name, column in rivals.items()
    ])
    long = df.select(*keys, F.inline(cells))
    present = long.groupBy(*keys, "variable").agg(F.count(F.lit(1)).alias("rows"))
    rho = spearman(long, [*keys, "variable"], "a", "b", "value").drop("n_pairs")
    return attach(present, rho, [*keys, "variable"], "left").drop("rows")


def feature_label_rho(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Spearman rho of every feature with the label, with p."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])
    long = df.select(F.col(label).cast("double").alias("y"), F.inline(cells))
    return spearman(long, ["feature"], "v", "y")


