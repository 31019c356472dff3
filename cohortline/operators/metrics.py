"""Agreement, classification and loss metrics over prediction rows.

Pointwise metrics are aggregate columns, so any number of them costs one
shuffle of partial sums. Ordered metrics (rank correlation, ROC, precision
recall) go through value counts and sliced running sums. NULL marks an
undefined value (one class, constant series) and is skipped by averages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.distributions import student_t_p
from cohortline.operators.rank import attach, pearson_expr, spearman, varies
from cohortline.operators.running import running, settle

EPS = 1e-7


# --- pointwise ---------------------------------------------------------------

def mse(t: Column, p: Column) -> Column:
    return F.avg((t - p) * (t - p))


def rmse(t: Column, p: Column) -> Column:
    return F.sqrt(mse(t, p))


def mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p))


def r2(t: Column, p: Column) -> Column:
    both = t.isNotNull() & p.isNotNull()
    tt = F.when(both, t)
    return F.when(varies(tt), F.lit(1.0) - F.try_divide(mse(t, p), F.var_pop(tt)))


def smape(t: Column, p: Column) -> Column:
    """Symmetric error as a fraction 0..2; a 0/0 row counts 0."""
    term = F.coalesce(F.try_divide(F.abs(t - p) * 2, F.abs(t) + F.abs(p)), F.lit(0.0))
    return F.avg(F.when(t.isNotNull() & p.isNotNull(), term))


def smape_percent(t: Column, p: Column) -> Column:
    return smape(t, p) * 100


def mape(t: Column, p: Column) -> Column:
    return F.avg(F.abs(F.try_divide(t - p, t)))


def accuracy(t: Column, p: Column) -> Column:
    return F.avg((t == p).cast("double"))


def pearson(t: Column, p: Column) -> Column:
    both = t.isNotNull() & p.isNotNull()
    return pearson_expr(F.when(both, t), F.when(both, p))


def mape_percent(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p) / F.greatest(F.abs(t), F.lit(EPS))) * 100


def msle(t: Column, p: Column) -> Column:
    d = F.log1p(F.greatest(t, F.lit(EPS))) - F.log1p(F.greatest(p, F.lit(EPS)))
    return F.avg(d * d)


def huber(t: Column, p: Column, delta: float = 1.0) -> Column:
    e = F.abs(t - p)
    return F.avg(F.when(e <= delta, e * e * 0.5).otherwise(e * delta - 0.5 * delta * delta))


def log_cosh(t: Column, p: Column) -> Column:
    e = F.abs(p - t)
    return F.avg(e + F.log1p(F.exp(e * -2.0)) - F.log(F.lit(2.0)))


def poisson(t: Column, p: Column) -> Column:
    return F.avg(p - t * F.log(p + EPS))


def _signed(t: Column) -> Column:
    return F.when(t == 0, -1.0).otherwise(t.cast("double"))


def hinge(t: Column, p: Column) -> Column:
    return F.avg(F.greatest(F.lit(1.0) - _signed(t) * p, F.lit(0.0)))


def squared_hinge(t: Column, p: Column) -> Column:
    m = F.greatest(F.lit(1.0) - _signed(t) * p, F.lit(0.0))
    return F.avg(m * m)


def _clip(p: Column, high: float = 1.0 - EPS) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(high))


def binary_crossentropy(t: Column, p: Column) -> Column:
    q = _clip(p)
    return F.avg(-(t * F.log(q) + (F.lit(1.0) - t) * F.log(F.lit(1.0) - q)))


def binary_crossentropy_logits(t: Column, x: Column) -> Column:
    return F.avg(F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))))


def relative_error(t: Column, p: Column) -> Column:
    return F.avg(F.abs(F.try_divide(p - t, t)))


# --- pointwise on arrays -----------------------------------------------------

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def categorical_crossentropy(t: Column, p: Column) -> Column:
    mass = _total(p)
    return F.avg(-_total(F.zip_with(t, p, lambda x, y: x * F.log(_clip(y / mass)))))


def sparse_categorical_crossentropy(t: Column, p: Column) -> Column:
    return F.avg(-F.log(_clip(F.get(p, t.cast("int")))))


def categorical_hinge(t: Column, p: Column) -> Column:
    positive = _dot(t, p)
    negative = F.array_max(F.zip_with(t, p, lambda x, y: (F.lit(1.0) - x) * y))
    return F.avg(F.greatest(negative - positive + 1.0, F.lit(0.0)))


def kl_divergence(t: Column, p: Column) -> Column:
    return F.avg(_total(F.zip_with(t, p, lambda x, y: _clip(x, 1.0) * F.log(_clip(x, 1.0) / _clip(y, 1.0)))))


def cosine_similarity(t: Column, p: Column) -> Column:
    return F.avg(F.try_divide(_dot(t, p), F.sqrt(_dot(t, t)) * F.sqrt(_dot(p, p))))


def categorical_accuracy(t: Column, p: Column) -> Column:
    same = F.array_position(t, F.array_max(t)) == F.array_position(p, F.array_max(p))
    return F.avg(same.cast("double"))


def sparse_categorical_accuracy(t: Column, p: Column) -> Column:
    return F.avg((F.array_position(p, F.array_max(p)) - 1 == t).cast("double"))


def top_k_accuracy(k: int) -> Callable[[Column, Column], Column]:
    """True class (an index) among the ``k`` largest scores; equal scores count for it."""

    def build(t: Column, p: Column) -> Column:
        own = F.get(p, t.cast("int"))
        return F.avg((F.size(F.filter(p, lambda v: v > own)) < k).cast("double"))

    return build


def threshold_accuracy(t: Column, p: Column, threshold: float = 0.5) -> Column:
    """Multi-label accuracy: share of matching 0/1 entries, averaged over rows."""
    hits = F.zip_with(t, p, lambda x, y: F.when((y > threshold).cast("int") == x.cast("int"), 1.0).otherwise(0.0))
    return F.avg(F.try_divide(_total(hits), F.size(t).cast("double")))


def fbeta_samples(t: Column, p: Column, beta: float = 2.0, threshold: float = 0.2) -> Column:
    """F-beta of each row's label set, averaged over rows."""
    flag = F.transform(p, lambda v: F.when(v > threshold, 1.0).otherwise(0.0))
    truth = F.transform(t, lambda v: v.cast("double"))
    hit = _dot(flag, truth)
    precision, recall = hit / (_total(flag) + 1e-9), hit / (_total(truth) + 1e-9)
    b2 = beta * beta
    return F.avg(precision * recall * (1 + b2) / (precision * b2 + recall + 1e-9))


# --- binary counts -----------------------------------------------------------

def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion_counts(t: Column, p: Column, positive: object = 1) -> dict[str, Column]:
    yes_t, yes_p = t == F.lit(positive), p == F.lit(positive)
    return {
        "tp": _count(yes_t & yes_p),
        "fp": _count(~yes_t & yes_p),
        "fn": _count(yes_t & ~yes_p),
        "tn": _count(~yes_t & ~yes_p),
    }


def _ratio(a: Column, b: Column) -> Column:
    """a / b with the convention 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def _of_counts(pick: Callable[[dict[str, Column]], Column]) -> Callable[[Column, Column], Column]:
    """An aggregate of the confusion counts of predicted against true classes, 1 being positive."""
    return lambda t, p: pick(confusion_counts(t, p))


def mean_iou(t: Column, p: Column) -> Column:
    """Mean over both classes of intersection over union; a class that doesn't occur counts 0."""
    c = confusion_counts(t, p)
    wrong = c["fp"] + c["fn"]
    return (_ratio(c["tp"], c["tp"] + wrong) + _ratio(c["tn"], c["tn"] + wrong)) / 2


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tp * 2, tp * 2 + fp + fn)


def binary_report(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, base rates, accuracy and both classes' precision / recall / F1."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[c.alias(n) for n, c in confusion_counts(F.col(truth), F.col(pred)).items()],
    )
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    pos, neg = precision_recall_f1(tp, fp, fn), precision_recall_f1(tn, fn, fp)
    return counts.select(
        *keys, "n", "tp", "fp", "fn", "tn",
        _ratio(tp + tn, n).alias("accuracy"),
        (tp + fn).alias("true_positives"), _ratio(tp + fn, n).alias("true_base_rate"),
        (tp + fp).alias("predicted_positives"), _ratio(tp + fp, n).alias("predicted_base_rate"),
        pos[0].alias("precision_pos"), pos[1].alias("recall_pos"), pos[2].alias("f1_pos"),
        neg[0].alias("precision_neg"), neg[1].alias("recall_neg"), neg[2].alias("f1_neg"),
    )


# --- class tables ------------------------------------------------------------

def confusion_long(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix as rows, with the share of each true class."""
    cells = df.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*keys, truth).agg(F.sum("n").alias("row_n"))
    return attach(cells, rows, [*keys, truth]).select(
        *keys, truth, pred, "n", (F.col("n") / F.col("row_n")).alias("share")
    )


def confusion_wide(df: DataFrame, truth: str, pred: str, classes: Sequence[object]) -> DataFrame:
    wide = df.groupBy(truth).pivot(pred, list(classes)).count()
    return wide.na.fill(0, [str(c) for c in classes])


def class_scores(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per class: support, tp, fp, fn, F1 and IoU. Each row feeds two partial sums."""
    marks = F.array(
        F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), (F.col(truth) == F.col(pred)).cast("int").alias("hit"), F.lit(0).alias("p")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).alias("t"), F.lit(0).alias("hit"), F.lit(1).alias("p")),
    )
    counted = (
        df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
        .select(*keys, F.inline(marks))
        .groupBy(*keys, "cls")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("tp"))
    )
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    return counted.select(
        *keys, "cls", "support", "tp", fp.alias("fp"), fn.alias("fn"),
        precision_recall_f1(tp, fp, fn)[2].alias("f1"),
        _ratio(tp, tp + fp + fn).alias("iou"),
    )


def f1_averages(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return class_scores(df, truth, pred, keys).groupBy(*keys).agg(
        _ratio(F.sum("tp") * 2, F.sum("tp") * 2 + F.sum("fp") + F.sum("fn")).alias("f1_micro"),
        F.avg("f1").alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.avg("iou").alias("mean_iou"),
    )


def kappa_linear(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa with weights |i - j| on integer classes.

    Expected disagreement needs sum over class pairs of n_i. * n_.j * |i - j|.
    The marginals are tiny tables joined on their group, so classes x classes
    rows appear per group, never row pairs.
    """
    t, p = F.col(truth).cast("long"), F.col(pred).cast("long")
    cells = df.filter(t.isNotNull() & p.isNotNull()).groupBy(*keys, t.alias("i"), p.alias("j")).agg(F.count(F.lit(1)).alias("n"))
    observed = cells.groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("i") - F.col("j"))).alias("o"), F.sum("n").alias("total"))
    # Walk the classes once: with both marginals on one axis the sum over pairs
    # of |i - j| is the area between the two cumulative distributions.
    axis = cells.select(*keys, F.inline(F.array(
        F.struct(F.col("i").alias("c"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")),
        F.struct(F.col("j").alias("c"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")),
    ))).groupBy(*keys, "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    walked = running(axis, keys, ["c"], {
        "a_n": ("sum", F.col("a")), "b_n": ("sum", F.col("b")),
        "a_s": ("sum", F.col("a") * F.col("c")), "b_s": ("sum", F.col("b") * F.col("c")),
    })
    gap = F.col("a") * (F.col("c") * F.col("b_n") - F.col("b_s")) + F.col("b") * (F.col("c") * F.col("a_n") - F.col("a_s"))
    expected = walked.groupBy(*keys).agg(F.sum(gap.cast("double")).alias("e"))
    both = attach(observed, expected, keys)
    return both.select(*keys, (F.lit(1.0) - F.try_divide(F.col("o") * F.col("total"), F.col("e"))).alias("kappa"))


# --- ordered metrics ---------------------------------------------------------

def score_counts(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    yes = (F.col(truth) == 1).cast("long")
    return (
        df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, score)
        .agg(F.sum(yes).alias("pos"), F.sum(F.lit(1).cast("long") - yes).alias("neg"))
    )


def _scored(df: DataFrame, truth: str, score: str, keys: Sequence[str]) -> DataFrame:
    """The columns an ordered metric reads, settled when they are derived."""
    return settle(df.select(*dict.fromkeys([*keys, truth, score])))


def roc_auc(df: DataFrame, truth: str, score: str, keys: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Exact ROC area with ties counted half; NULL where only one class occurs."""
    df = _scored(df, truth, score, keys)
    walked = running(
        score_counts(df, truth, score, keys), keys, [score], {"neg_below": ("sum", F.col("neg"))},
        source=df.select(*keys, score),
    )
    won = F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))
    return walked.groupBy(*keys).agg(
        F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias(name)
    )


def pr_curve(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative tp / fp at every distinct threshold, highest first."""
    df = _scored(df, truth, score, keys)
    counts = score_counts(df, truth, score, keys)
    walked = running(
        counts, keys, [score], {"tp_above": ("sum", F.col("pos")), "fp_above": ("sum", F.col("neg"))},
        descending=True, source=df.select(*keys, score),
    )
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    full = attach(walked, totals, keys)
    tp, fp = F.col("tp_above") + F.col("pos"), F.col("fp_above") + F.col("neg")
    return full.select(
        *keys, F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        (F.col("p_all") - tp).alias("fn"), (F.col("n_all") - fp).alias("tn"),
        F.col("pos").alias("pos_here"),
        (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp.cast("double"), F.col("p_all").cast("double")).alias("recall"),
        F.try_divide(fp.cast("double"), F.col("n_all").cast("double")).alias("fpr"),
    )


def average_precision(df: DataFrame, truth: str, score: str, keys: Sequence[str] = (), name: str = "auprc") -> DataFrame:
    df = _scored(df, truth, score, keys)
    walked = running(
        score_counts(df, truth, score, keys), keys, [score],
        {"tp_above": ("sum", F.col("pos")), "fp_above": ("sum", F.col("neg"))},
        descending=True, source=df.select(*keys, score),
    )
    tp = F.col("tp_above") + F.col("pos")
    precision = tp / (tp + F.col("fp_above") + F.col("neg"))
    return walked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos").cast("double")).alias(name)
    )


def operating_points(df: DataFrame, truth: str, score: str, level: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Best precision / recall / sensitivity / specificity with its counterpart at ``level`` or more."""
    curve = pr_curve(df, truth, score, keys)
    specificity = F.lit(1.0) - F.col("fpr")
    return curve.groupBy(*keys).agg(
        F.max(F.when(F.col("recall") >= level, F.col("precision"))).alias("precision_at_recall"),
        F.max(F.when(F.col("precision") >= level, F.col("recall"))).alias("recall_at_precision"),
        F.max(F.when(specificity >= level, F.col("recall"))).alias("sensitivity_at_specificity"),
        F.max(F.when(F.col("recall") >= level, specificity)).alias("specificity_at_sensitivity"),
    )


def threshold_report(df: DataFrame, truth: str, score: str, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    flagged = df.withColumn("__flag", F.when(F.col(score) >= threshold, 1).otherwise(0))
    return binary_report(flagged, truth, "__flag", keys)


def multiclass_auc(df: DataFrame, truth: str, scores: Mapping[int, str], keys: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest ROC area: macro, support-weighted and micro.

    ``scores`` maps a class value to its score column.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("cls"), (F.col(truth) == F.lit(c)).cast("int").alias("is_cls"), F.col(s).cast("double").alias("score"))
        for c, s in scores.items()
    ])
    long = df.filter(F.col(truth).isNotNull()).select(*keys, F.inline(cells))
    per_class = roc_auc(long, "is_cls", "score", [*keys, "cls"])
    support = long.groupBy(*keys, "cls").agg(F.sum("is_cls").alias("support"))
    averaged = attach(per_class, support, [*keys, "cls"]).groupBy(*keys).agg(
        F.avg("auc").alias("auc_macro"),
        F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum(F.when(F.col("auc").isNotNull(), F.col("support"))).cast("double")).alias("auc_weighted"),
    )
    micro = roc_auc(long, "is_cls", "score", keys, "auc_micro")
    return attach(averaged, micro, keys)


def correlation_with_p(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = (), kind: str = "pearson") -> DataFrame:
    """Correlation, pair count and two-sided p (t with n - 2 degrees of freedom)."""
    if kind == "spearman":
        base = spearman(df, keys, truth, pred, "r")
    else:
        both = df.dropna(subset=[truth, pred])
        base = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), pearson(F.col(truth), F.col(pred)).alias("r"))
    dof = (F.col("n_pairs") - 2).cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(dof, F.lit(1.0) - F.col("r") * F.col("r")))
    perfect = F.abs(F.col("r")) >= 1.0 - 1e-14
    p = F.when(perfect & (dof > 0), F.lit(0.0)).otherwise(student_t_p(F.when(~perfect & (dof > 0), t), dof))
    return base.select(*keys, "n_pairs", "r", p.alias("p_value"))


# --- registry ----------------------------------------------------------------

@dataclass(frozen=True)
class Metric:
    """``better`` is max or min; exactly one of the two builders is set."""

    better: str
    expr: Callable[[Column, Column], Column] | None = None
    table: Callable[..., DataFrame] | None = None
    sign: float = 1.0


def _f1(which: str) -> Callable[..., DataFrame]:
    return lambda df, t, p, keys, name: f1_averages(df, t, p, keys).select(*keys, F.col(f"f1_{which}").alias(name))


def _point(which: str) -> Callable[..., DataFrame]:
    return lambda df, t, p, keys, name: operating_points(df, t, p, 0.5, keys).select(*keys, F.col(which).alias(name))


def _class_auc(which: str) -> Callable[..., DataFrame]:
    """One-vs-rest AUC of an array of class probabilities; the true class is an index into it."""

    def table(df: DataFrame, t: str, p: str, keys: Sequence[str], name: str) -> DataFrame:
        cells = F.transform(F.col(p), lambda x, i: F.struct(i.alias("cls"), (F.col(t).cast("int") == i).cast("int").alias("is_cls"), x.cast("double").alias("score")))
        long = df.filter(F.col(t).isNotNull() & F.col(p).isNotNull()).select(*keys, F.inline(cells))
        if which == "micro":
            return roc_auc(long, "is_cls", "score", keys, name)
        per_class = roc_auc(long, "is_cls", "score", [*keys, "cls"])
        if which == "macro":
            return per_class.groupBy(*keys).agg(F.avg("auc").alias(name))
        support = long.groupBy(*keys, "cls").agg(F.sum("is_cls").alias("support"))
        weighed = attach(per_class, support, [*keys, "cls"]).filter(F.col("auc").isNotNull())
        return weighed.groupBy(*keys).agg(F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support").cast("double")).alias(name))

    return table


METRICS: dict[str, Metric] = {
    "mse": Metric("min", mse),
    "rmse": Metric("min", rmse),
    "mae": Metric("min", mae),
    "r2": Metric("max", r2),
    "smape": Metric("min", smape),
    "smape_percent": Metric("min", smape_percent),
    "mape": Metric("min", mape),
    "mape_percent": Metric("min", mape_percent),
    "msle": Metric("min", msle),
    "huber": Metric("min", huber),
    "smooth_l1": Metric("min", huber),
    "log_cosh": Metric("min", log_cosh),
    "poisson": Metric("min", poisson),
    "hinge": Metric("min", hinge),
    "squared_hinge": Metric("min", squared_hinge),
    "binary_crossentropy": Metric("min", binary_crossentropy),
    "binary_crossentropy_logits": Metric("min", binary_crossentropy_logits),
    "categorical_crossentropy": Metric("min", categorical_crossentropy),
    "sparse_categorical_crossentropy": Metric("min", sparse_categorical_crossentropy),
    "categorical_hinge": Metric("min", categorical_hinge),
    "kl_divergence": Metric("min", kl_divergence),
    "cosine_similarity": Metric("max", cosine_similarity),
    "relative_error": Metric("min", relative_error),
    "accuracy": Metric("max", accuracy),
    "categorical_accuracy": Metric("max", categorical_accuracy),
    "sparse_categorical_accuracy": Metric("max", sparse_categorical_accuracy),
    "top_5_accuracy": Metric("max", top_k_accuracy(5)),
    "pearson": Metric("max", pearson),
    "spearman": Metric("max", table=lambda df, t, p, keys, name: spearman(df, keys, t, p, name).select(*keys, name)),
    "roc_auc": Metric("max", table=lambda df, t, p, keys, name: roc_auc(df, t, p, keys, name)),
    "roc_auc_ovr": Metric("max", table=_class_auc("macro")),
    "roc_auc_ovr_micro": Metric("max", table=_class_auc("micro")),
    "roc_auc_ovr_weighted": Metric("max", table=_class_auc("weighted")),
    "average_precision": Metric("max", table=lambda df, t, p, keys, name: average_precision(df, t, p, keys, name)),
    "f1_micro": Metric("max", table=_f1("micro")),
    "f1_macro": Metric("max", table=_f1("macro")),
    "f1_weighted": Metric("max", table=_f1("weighted")),
    "binary_accuracy": Metric("max", lambda t, p: F.avg((t == (p > 0.5).cast("int")).cast("double"))),
    "precision": Metric("max", _of_counts(lambda c: _ratio(c["tp"], c["tp"] + c["fp"]))),
    "recall": Metric("max", _of_counts(lambda c: _ratio(c["tp"], c["tp"] + c["fn"]))),
    "f1": Metric("max", _of_counts(lambda c: _ratio(c["tp"] * 2, c["tp"] * 2 + c["fp"] + c["fn"]))),
    "precision_neg": Metric("max", _of_counts(lambda c: _ratio(c["tn"], c["tn"] + c["fn"]))),
    "recall_neg": Metric("max", _of_counts(lambda c: _ratio(c["tn"], c["tn"] + c["fp"]))),
    "f1_neg": Metric("max", _of_counts(lambda c: _ratio(c["tn"] * 2, c["tn"] * 2 + c["fp"] + c["fn"]))),
    "true_positives": Metric("max", _of_counts(lambda c: c["tp"])),
    "true_negatives": Metric("max", _of_counts(lambda c: c["tn"])),
    "false_positives": Metric("min", _of_counts(lambda c: c["fp"])),
    "false_negatives": Metric("min", _of_counts(lambda c: c["fn"])),
    "mean_iou": Metric("max", mean_iou),
    "sum": Metric("max", lambda t, p: F.sum(p)),
    "mean": Metric("max", lambda t, p: F.avg(p)),
    "precision_at_recall": Metric("max", table=_point("precision_at_recall")),
    "recall_at_precision": Metric("max", table=_point("recall_at_precision")),
    "sensitivity_at_specificity": Metric("max", table=_point("sensitivity_at_specificity")),
    "specificity_at_sensitivity": Metric("max", table=_point("specificity_at_sensitivity")),
    "kappa_linear": Metric("max", table=lambda df, t, p, keys, name: kappa_linear(df, t, p, keys).select(*keys, F.col("kappa").alias(name))),
}


def get_metric(name: str) -> Metric:
    """Look a metric up by name; ``neg_x`` is the plain negation of ``x``."""
    if name in METRICS:
        return METRICS[name]
    if name.startswith("neg_") and name[4:] in METRICS:
        base = METRICS[name[4:]]
        return Metric("max" if base.better == "min" else "min", base.expr, base.table, -base.sign)
    raise KeyError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")


def default_metric(task: str) -> str:
    return {"regression": "mse", "binary": "roc_auc", "multiclass": "f1_macro"}[task]


def evaluate(
    df: DataFrame,
    truth: str,
    pred: str,
    metrics: Sequence[str | tuple[str, Metric]],
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per group with every requested metric and the row count.

    A metric is a registry name or ``(name, Metric)``, whose direction is stated, so
    that a tuned error is not taken for a score.
    """
    plain, tables, order = [F.count(F.lit(1)).alias("n")], [], []
    for item in metrics:
        if isinstance(item, str):
            metric, name = get_metric(item), item
        else:
            name, metric = item
            if not isinstance(metric, Metric):
                raise TypeError(f"give {name!r} as a Metric with its direction")
        order.append(name)
        if metric.expr is not None:
            plain.append((metric.expr(F.col(truth), F.col(pred)) * F.lit(metric.sign)).alias(name))
        else:
            tables.append((name, metric))
    out = df.groupBy(*keys).agg(*plain)
    for name, metric in tables:
        table = metric.table(df, truth, pred, list(keys), name)
        out = attach(out, table.withColumn(name, F.col(name) * F.lit(metric.sign)), list(keys), "left")
    return out.select(*keys, "n", *order)


def metrics_per_fold(
    df: DataFrame, truth: str, pred: str, fold: str, metrics: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Metrics on each fold's test rows with test and train sizes."""
    scored = evaluate(df, truth, pred, metrics, [*keys, fold]).withColumnRenamed("n", "n_test")
    sizes = scored.groupBy(*keys).agg(F.sum("n_test").alias("n_all"))
    full = attach(scored, sizes, list(keys))
    return full.withColumn("n_train", F.col("n_all") - F.col("n_test")).drop("n_all")
