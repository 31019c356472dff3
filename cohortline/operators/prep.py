"""Feature preparation: statistics from training rows, applied to any rows.

Two forms. The ``fit_*`` functions return a small Spark ML style model for one
training set. The ``*_out_of_fold`` functions serve all folds at once: every
fold is summarised once, the training statistics of fold k are merged from the
other folds' summaries (k rows), and each row gets those of its own fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.rank import attach, exact_quantiles, group_mode, varies
from cohortline.operators.rows import hash_order
from cohortline.operators.running import row_positions


# --- per-fold statistics in one pass ------------------------------------------

def fold_train_moments(df: DataFrame, fold: str, columns: Sequence[str]) -> DataFrame:
    """Count, mean, population sd, min and max of the *other* folds' rows, per fold.

    One pass over the table; the merge works on one row per fold and column.
    """
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.var_pop(c).alias("var"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"),
        )
        for c in columns
    ]
    per_fold = df.groupBy(fold).agg(F.array(*cells).alias("s")).select(fold, F.inline("s"))
    mine = per_fold.select(F.col(fold).alias("__own"), F.col("column").alias("__c"))
    pairs = mine.join(per_fold, (F.col("__c") == F.col("column")) & (F.col("__own") != F.col(fold)))
    n, mean = F.col("n"), F.col("mean")
    merged = pairs.groupBy(F.col("__own").alias(fold), "column").agg(
        F.sum("n").alias("n"),
        F.sum(n * mean).alias("sx"),
        F.sum(n * F.col("var")).alias("within"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.collect_list(F.struct("n", "mean")).alias("parts"),
    )
    centre = F.try_divide(F.col("sx"), F.col("n"))
    withc = merged.withColumn("mean", centre)
    between = F.aggregate(
        "parts", F.lit(0.0),
        lambda s, p: s + F.coalesce(p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")), F.lit(0.0)),
    )
    variance = F.try_divide(F.col("within") + between, F.col("n").cast("double"))
    sd = F.when(F.col("low") < F.col("high"), F.sqrt(variance)).when(F.col("low").isNotNull(), 0.0)
    return withc.select(fold, "column", "n", "mean", sd.alias("sd"), "low", "high")


def _stats_by_fold(moments: DataFrame, fold: str, columns: Sequence[str], stat: str) -> DataFrame:
    return moments.groupBy(fold).agg(*[F.max(F.when(F.col("column") == c, F.col(stat))).alias(f"__{stat}_{c}") for c in columns])


def impute_out_of_fold(df: DataFrame, fold: str, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the mean of the other folds' rows."""
    stats = _stats_by_fold(fold_train_moments(df, fold, columns), fold, columns, "mean")
    joined = attach(df, stats, [fold], bounded=True)
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__mean_{c}")) for c in columns}).select(*df.columns)


def scale_out_of_fold(
    df: DataFrame, fold: str, columns: Sequence[str], strategy: str = "standardize", low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Standardise (population sd) or min-max scale with the other folds' statistics."""
    moments = fold_train_moments(df, fold, columns)
    a, b = ("mean", "sd") if strategy == "standardize" else ("low", "high")
    joined = df
    for stat in (a, b):
        joined = attach(joined, _stats_by_fold(moments, fold, columns, stat), [fold], bounded=True)

    def scaled(c: str) -> Column:
        first, second = F.col(f"__{a}_{c}"), F.col(f"__{b}_{c}")
        if strategy == "standardize":
            return (F.col(c) - first) / F.when(second == 0, 1.0).otherwise(second)
        span = second - first
        return (F.col(c) - first) / F.when(span == 0, 1.0).otherwise(span) * (high - low) + low

    return joined.withColumns({c: scaled(c) for c in columns}).select(*df.columns)


# --- fitted on one training set -----------------------------------------------

def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.inline(cells))


def imputation_values(train: DataFrame, columns: Sequence[str], strategy: str, fill: float = 0.0) -> list[float]:
    """One number per column, computed on the training rows in one job."""
    if strategy == "constant":
        return [float(fill)] * len(columns)
    if strategy == "mean":
        row = train.agg(*[F.avg(c).alias(c) for c in columns]).first()
        found = row.asDict()
    elif strategy == "median":
        found = dict(exact_quantiles(_long(train, columns), ["column"], "v", [0.5], ["m"]).collect())
    elif strategy == "most_frequent":
        found = {r["column"]: r["m"] for r in group_mode(_long(train, columns), ["column"], "v", "m").collect()}
    else:
        raise ValueError(f"unknown imputation strategy {strategy!r}")
    return [float(found[c]) if found.get(c) is not None else float(fill) for c in columns]


class _ColumnStats(Params):
    first_values = Param(Params._dummy(), "first_values", "subtracted or filled values", TypeConverters.toListFloat)
    second_values = Param(Params._dummy(), "second_values", "divisors", TypeConverters.toListFloat)
    base = Param(Params._dummy(), "base", "added after scaling", TypeConverters.toFloat)


class TrainImputerModel(Model, HasInputCols, _ColumnStats, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = self.getOrDefault(self.first_values)
        return dataset.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in zip(self.getInputCols(), values)}
        )


class TrainImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Mean, exact median, most frequent or constant imputation."""

    strategy = Param(Params._dummy(), "strategy", "mean, median, most_frequent or constant", TypeConverters.toString)
    fill = Param(Params._dummy(), "fill", "constant, also for all-null columns", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, strategy="mean", fill=0.0):
        super().__init__()
        self._setDefault(strategy="mean", fill=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TrainImputerModel:
        columns = self.getInputCols()
        values = imputation_values(dataset, columns, self.getOrDefault(self.strategy), self.getOrDefault(self.fill))
        return TrainImputerModel()._set(inputCols=columns, first_values=values)


class TrainScalerModel(Model, HasInputCols, _ColumnStats, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        first, second, base = (self.getOrDefault(p) for p in (self.first_values, self.second_values, self.base))
        return dataset.withColumns(
            {c: (F.col(c) - F.lit(a)) / F.lit(b) + F.lit(base) for c, a, b in zip(self.getInputCols(), first, second)}
        )


class TrainScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Standardise with the population sd, or min-max scale to a range."""

    strategy = Param(Params._dummy(), "strategy", "standardize or min-max", TypeConverters.toString)
    low = Param(Params._dummy(), "low", "lower end of the range", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "upper end of the range", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, strategy="standardize", low=0.0, high=1.0):
        super().__init__()
        self._setDefault(strategy="standardize", low=0.0, high=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TrainScalerModel:
        columns, strategy = self.getInputCols(), self.getOrDefault(self.strategy)
        if strategy == "standardize":
            one, two = F.avg, lambda c: F.when(varies(F.col(c)), F.stddev_pop(c))
        elif strategy == "min-max":
            one, two = F.min, F.max
        else:
            raise ValueError(f"unknown scaling strategy {strategy!r}")
        row = dataset.agg(*[one(c).cast("double").alias(f"a{i}") for i, c in enumerate(columns)],
                          *[two(c).cast("double").alias(f"b{i}") for i, c in enumerate(columns)]).first()
        first = [row[f"a{i}"] or 0.0 for i in range(len(columns))]
        second = [row[f"b{i}"] or 0.0 for i in range(len(columns))]
        base = 0.0
        if strategy == "min-max":
            low, high = self.getOrDefault(self.low), self.getOrDefault(self.high)
            second = [((b - a) or 1.0) / (high - low) for a, b in zip(first, second)]
            base = low
        return TrainScalerModel()._set(inputCols=columns, first_values=first, second_values=[s or 1.0 for s in second], base=base)


def fit_transform_rows(estimator: Estimator, df: DataFrame, is_fit: Column | None, is_apply: Column | None = None) -> DataFrame:
    """Fit on the rows ``is_fit`` selects, transform those ``is_apply`` selects.

    Refuses a missing fit selection: fitting on everything must be said aloud
    with ``F.lit(True)``.
    """
    if is_fit is None:
        raise ValueError("name the rows to fit on")
    return estimator.fit(df.filter(is_fit)).transform(df if is_apply is None else df.filter(is_apply))


# --- encoders -----------------------------------------------------------------

def class_table(df: DataFrame, label: str, lower: bool = True) -> DataFrame:
    """Distinct classes in sorted order with their index: ``(cls, idx)``."""
    value = F.lower(F.col(label).cast("string")) if lower else F.col(label)
    classes = df.select(value.alias("cls")).filter(F.col("cls").isNotNull()).distinct()
    return row_positions(classes, [], ["cls"]).select("cls", F.col("pos").cast("int").alias("idx"))


def encode_label(df: DataFrame, label: str, classes: DataFrame, name: str) -> DataFrame:
    joined = df.withColumn("cls", F.lower(F.col(label).cast("string")))
    return attach(joined, classes.withColumnRenamed("idx", name), ["cls"], "left").drop("cls")


def decode_label(df: DataFrame, index: str, classes: DataFrame, name: str) -> DataFrame:
    return attach(df, classes.select(F.col("idx").alias(index), F.col("cls").alias(name)), [index], "left")


def one_hot(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """0/1 columns ``column_value`` for the listed values."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in values})


def distinct_values(df: DataFrame, column: str, limit: int) -> list[object]:
    """Sorted distinct values for ``one_hot``; refuses more than ``limit`` new columns."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; one-hot columns would not be useful")
    return sorted(r[0] for r in rows)


def one_vs_rest(df: DataFrame, label: str, positive: str, name: str) -> DataFrame:
    return df.withColumn(name, F.when(F.lower(F.col(label).cast("string")) == positive.lower(), 1).otherwise(0))


def binarise_at_median(
    df: DataFrame, columns: Sequence[str], group: str | None = None, fit_on: DataFrame | None = None
) -> DataFrame:
    """``> median`` to 1, else 0, overall or per group; NULL stays NULL.

    Without ``fit_on`` the medians are those of the given rows; with it they
    come from the training rows.
    """
    source = fit_on if fit_on is not None else df
    keys = [group] if group else []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    medians = exact_quantiles(source.select(*keys, F.inline(cells)), [*keys, "column"], "v", [0.5], ["m"])
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"__m_{c}") for c in columns])
    joined = attach(df, wide, keys, "left")
    flags = {c: F.when(F.col(c).isNotNull(), (F.col(c) > F.col(f"__m_{c}")).cast("int")) for c in columns}
    return joined.withColumns(flags).select(*df.columns)


def multilabel_targets(df: DataFrame, columns: Sequence[str], name: str = "targets") -> DataFrame:
    from cohortline.functions.scalar import positive_flag

    return df.withColumn(name, F.array(*[positive_flag(F.col(c).cast("string")) for c in columns]))


def join_blocks(df: DataFrame, blocks: Sequence[str], name: str = "features") -> DataFrame:
    """Concatenate feature arrays; arrays of steps are joined step by step."""
    nested = df.schema[blocks[0]].dataType.elementType.typeName() == "array"
    if not nested:
        return df.withColumn(name, F.concat(*[F.col(b) for b in blocks]))
    out = F.col(blocks[0])
    for b in blocks[1:]:
        out = F.zip_with(out, F.col(b), lambda x, y: F.concat(x, y))
    return df.withColumn(name, out)


# --- resampling ---------------------------------------------------------------

def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    return sizes


def undersample(df: DataFrame, label: str, row_id: str, seed: int = 17, order: Sequence[str] | None = None) -> DataFrame:
    """Keep as many rows of every class as the smallest class has, in seeded hash order."""
    smallest = _class_sizes(df, label).agg(F.min("__n").alias("m")).scalar()
    mixed = df.withColumn("__mix", hash_order(seed, row_id)) if order is None else df
    placed = row_positions(mixed, [label], [*(order or ["__mix"]), row_id], "__pos")
    return placed.filter(F.col("__pos") < smallest).select(*df.columns)


def oversample(df: DataFrame, label: str, row_id: str, seed: int = 17, order: Sequence[str] | None = None) -> DataFrame:
    """Repeat rows until every class has the size of the largest; adds ``copy`` (0 = original).

    Row number p of a class with n rows is needed at p, p + n, p + 2n, ... below
    the target, so the repeats spread evenly over the class.
    """
    sizes = _class_sizes(df, label)
    target = sizes.agg(F.max("__n").alias("m")).scalar()
    mixed = df.withColumn("__mix", hash_order(seed, row_id)) if order is None else df
    placed = row_positions(mixed, [label], [*(order or ["__mix"]), row_id], "__pos")
    sized = attach(placed, sizes, [label])
    last = F.floor((target - 1 - F.col("__pos")) / F.col("__n")).cast("int")
    return sized.withColumn("copy", F.explode(F.sequence(F.lit(0), last))).select(*df.columns, "copy")


def resample(df: DataFrame, label: str, row_id: str, method: str = "none", seed: int = 17, **args: object) -> DataFrame:
    """Named choice of resampler."""
    if method == "none":
        return df
    if method == "under":
        return undersample(df, label, row_id, seed)
    if method == "over":
        return oversample(df, label, row_id, seed).drop("copy")
    if method == "smote":
        from cohortline.operators.smote import smote

        return smote(df, label, row_id, seed=seed, **args)
    raise KeyError(f"unknown resampling method {method!r}")
