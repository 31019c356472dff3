"""Subject-level agreement and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query, r6, rounded
from cohortline.catalog.tables import (
    GROUPS_SQL, SMAPE_SQL, binary_scores, load, multiclass, oof, predictions, sql_corr, sql_ranks, sql_t_p, surveys, with_views,
)
from cohortline.operators import metrics as M
from cohortline.operators.rank import average_rank
from cohortline.operators.summary import agreement, compliance, reference_means, second_level, subject_summary

KEYS = ["snapshot_id", "Model", "Label"]


@query("subject_agreement", with_views("predictions", """
select Model, Label, count(*) as subjects, round(avg(rho), 6) + 0.0 as rho_mn, round(stddev_samp(rho), 6) + 0.0 as rho_sd,
  round(avg(smape), 6) + 0.0 as smape_mn, round(stddev_samp(smape), 6) + 0.0 as smape_sd,
  round(avg(mape), 6) + 0.0 as mape_mn
from g group by Model, Label""", GROUPS_SQL))
def subject_agreement(spark, sf):
    subjects = agreement(predictions(spark, sf), KEYS)
    out = second_level(subjects, ["Model", "Label"], ["rho", "smape", "mape"]).drop("mape_sd")
    return rounded(out, "rho_mn", "rho_sd", "smape_mn", "smape_sd", "mape_mn")


@query("subject_summary", with_views("predictions", """
select snapshot_id, Model, Label, n, n_classes, round(true_mn + 1e-9, 6) as true_mn, round(pred_mn + 1e-9, 6) as pred_mn,
  round(true_sd, 6) + 0.0 as true_sd, round(pred_sd, 6) + 0.0 as pred_sd, round(smape, 6) + 0.0 as smape,
  round(mape, 6) + 0.0 as mape, round(rho, 6) + 0.0 as rho from g""", GROUPS_SQL))
def subject_summary_query(spark, sf):
    out = subject_summary(predictions(spark, sf), KEYS)
    # Means of short decimals can sit exactly on a rounding edge; both sides step off it.
    out = out.withColumns({c: F.col(c) + 1e-9 for c in ("true_mn", "pred_mn")})
    return rounded(out, "true_mn", "pred_mn", "true_sd", "pred_sd", "smape", "mape", "rho")


@query("tie_ranks", with_views("predictions", f"""
select Model, True_value, count(*) as n, min(rk) as rank_avg from
({sql_ranks('predictions', 'Model', {'rk': 'True_value'})}) group by Model, True_value"""))
def tie_ranks_query(spark, sf):
    ranked = average_rank(predictions(spark, sf).select("Model", "True_value"), ["Model"], "True_value", "rk")
    return ranked.groupBy("Model", "True_value").agg(F.count(F.lit(1)).alias("n"), F.min("rk").alias("rank_avg"))


_REG = f"""select Model, Label, count(*) as n,
  round({sql_corr('True_value', 'Predicted_value')}, 6) + 0.0 as pearson,
  round(avg((True_value - Predicted_value) * (True_value - Predicted_value)), 6) + 0.0 as mse,
  round(sqrt(avg((True_value - Predicted_value) * (True_value - Predicted_value))), 6) + 0.0 as rmse,
  round(1 - avg((True_value - Predicted_value) * (True_value - Predicted_value)) / nullif(var_pop(True_value), 0) + 1e-9, 6) + 0.0 as r2,
  round({SMAPE_SQL}, 6) + 0.0 as smape,
  round({sql_corr('rt', 'rp')}, 6) + 0.0 as spearman
from r group by Model, Label"""


@query("reg_metrics", with_views("oof", _REG, f"r as ({sql_ranks('oof', 'Model, Label', {'rt': 'True_value', 'rp': 'Predicted_value'})})"))
def reg_metrics(spark, sf):
    names = ["pearson", "mse", "rmse", "r2", "smape", "spearman"]
    out = M.evaluate(oof(spark, sf), "True_value", "Predicted_value", names, ["Model", "Label"])
    return rounded(out.withColumn("r2", F.col("r2") + 1e-9), *names)


@query("correlation_p", with_views("oof", f"""
select Model, Label, n_pairs, round(r, 6) + 0.0 as r, round({sql_t_p('(r * sqrt((n_pairs - 2) / (1 - r * r)))', '(n_pairs - 2)')}, 6) + 0.0 as p_value, kind from c""",
f"""r as ({sql_ranks('oof', 'Model, Label', {'ra': 'True_value', 'rb': 'Predicted_value'})}),
c as (select Model, Label, count(*) as n_pairs, {sql_corr('True_value', 'Predicted_value')} as r, 'pearson' as kind from oof group by Model, Label
  union all select Model, Label, count(*), {sql_corr('ra', 'rb')}, 'spearman' from r group by Model, Label)"""))
def correlation_p(spark, sf):
    """Correlations with p values; SQL has a finite series for whole degrees of freedom."""
    df = oof(spark, sf)
    one = M.correlation_with_p(df, "True_value", "Predicted_value", ["Model", "Label"]).withColumn("kind", F.lit("pearson"))
    two = M.correlation_with_p(df, "True_value", "Predicted_value", ["Model", "Label"], "spearman").withColumn("kind", F.lit("spearman"))
    return rounded(one.unionByName(two), "r", "p_value")


@query("compliance", with_views("predictions", """
select snapshot_id, n, row_number() over (order by n desc, snapshot_id) as idx, n >= 600 as compliant
from (select snapshot_id, count(*) as n from predictions group by snapshot_id)"""))
def compliance_query(spark, sf):
    return compliance(predictions(spark, sf), "snapshot_id", 600)


@query("distinct_subjects", with_views("predictions", """
select Model, count(distinct snapshot_id) as subjects, count(distinct True_value) as n_classes from predictions group by Model"""))
def distinct_subjects(spark, sf):
    # One distinct column per aggregation avoids expanding every row twice.
    df = predictions(spark, sf)
    subjects = df.select("Model", "snapshot_id").distinct().groupBy("Model").agg(F.count("snapshot_id").alias("subjects"))
    classes = df.select("Model", "True_value").distinct().groupBy("Model").agg(F.count("True_value").alias("n_classes"))
    return subjects.join(classes, "Model")


@query("confusion", with_views("multiclass", """
select truth, pred, n, round(n / sum(n) over (partition by truth), 6) as share
from (select truth, pred, count(*) as n from multiclass group by truth, pred)"""))
def confusion(spark, sf):
    return rounded(M.confusion_long(multiclass(spark, sf), "truth", "pred"), "share")


_FLAG = "f as (select *, case when score >= 0.05 then 1 else 0 end as pred from binary_scores)"
_CM = """c as (select snapshot_id, count(*) as n,
  cast(sum(case when truth = 1 and pred = 1 then 1 else 0 end) as bigint) as tp,
  cast(sum(case when truth <> 1 and pred = 1 then 1 else 0 end) as bigint) as fp,
  cast(sum(case when truth = 1 and pred <> 1 then 1 else 0 end) as bigint) as fn,
  cast(sum(case when truth <> 1 and pred <> 1 then 1 else 0 end) as bigint) as tn from f group by snapshot_id)"""


def _prf(tp: str, fp: str, fn: str, tag: str) -> str:
    return f"""round(case when {tp} + {fp} = 0 then 0.0 else {tp} * 1.0 / ({tp} + {fp}) end, 6) as precision_{tag},
  round(case when {tp} + {fn} = 0 then 0.0 else {tp} * 1.0 / ({tp} + {fn}) end, 6) as recall_{tag},
  round(case when 2 * {tp} + {fp} + {fn} = 0 then 0.0 else 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) end, 6) as f1_{tag}"""


@query("binary_metrics", with_views("binary_scores", f"""
select snapshot_id, n, tp, fp, fn, tn, round((tp + tn) * 1.0 / n, 6) as accuracy,
  tp + fn as true_positives, round((tp + fn) * 1.0 / n, 6) as true_base_rate,
  tp + fp as predicted_positives, round((tp + fp) * 1.0 / n, 6) as predicted_base_rate,
  {_prf('tp', 'fp', 'fn', 'pos')}, {_prf('tn', 'fn', 'fp', 'neg')} from c""", _FLAG + ",\n" + _CM))
def binary_metrics(spark, sf):
    out = M.threshold_report(binary_scores(spark, sf), "truth", "score", 0.05, ["snapshot_id"])
    real = [c for c, t in out.dtypes if t == "double"]
    return rounded(out, *real)


_SCORES = """s as (select snapshot_id, score, sum(truth) as pos, sum(1 - truth) as neg from binary_scores group by snapshot_id, score),
w as (select *, coalesce(sum(neg) over (partition by snapshot_id order by score rows between unbounded preceding and 1 preceding), 0) as below,
  sum(pos) over (partition by snapshot_id order by score desc) as tp, sum(neg) over (partition by snapshot_id order by score desc) as fp,
  sum(pos) over (partition by snapshot_id) as p_all, sum(neg) over (partition by snapshot_id) as n_all from s)"""


@query("auc_exact", with_views("binary_scores", """
select snapshot_id, round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) as auc,
  round(sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0), 6) as auprc from w group by snapshot_id""", _SCORES))
def auc_exact(spark, sf):
    df = binary_scores(spark, sf)
    out = M.roc_auc(df, "truth", "score", ["snapshot_id"]).join(
        M.average_precision(df, "truth", "score", ["snapshot_id"]), "snapshot_id"
    )
    return rounded(out, "auc", "auprc")


@query("pr_curve", with_views("binary_scores", """
select snapshot_id, round(score, 6) as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
  cast(p_all - tp as bigint) as fn, cast(n_all - fp as bigint) as tn,
  round(tp / (tp + fp), 6) as precision, round(tp / nullif(p_all, 0), 6) as recall,
  round(fp / nullif(n_all, 0), 6) as fpr from w""", _SCORES))
def pr_curve(spark, sf):
    out = M.pr_curve(binary_scores(spark, sf), "truth", "score", ["snapshot_id"]).drop("pos_here")
    return rounded(out, "threshold", "precision", "recall", "fpr")


@query("kappa_linear", with_views("multiclass", """
select round(1 - o.v * t.n / e.v, 6) as kappa from
  (select sum(abs(truth - pred)) as v from multiclass) o,
  (select count(*) as n from multiclass) t,
  (select sum(a.n * b.n * abs(a.truth - b.pred)) as v from
    (select truth, count(*) as n from multiclass group by truth) a,
    (select pred, count(*) as n from multiclass group by pred) b) e"""))
def kappa_linear(spark, sf):
    return rounded(M.kappa_linear(multiclass(spark, sf), "truth", "pred"), "kappa")


@query("f1_avgs", with_views("multiclass", """
select round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as f1_micro, round(avg(f1), 6) as f1_macro,
  round(sum(f1 * support) / sum(support), 6) as f1_weighted,
  round(avg(case when tp + fp + fn = 0 then 0.0 else tp * 1.0 / (tp + fp + fn) end), 6) as mean_iou
from (select *, case when 2 * tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end as f1 from k)""",
"""k as (select c.cls, count(*) filter (truth = cls) as support, count(*) filter (truth = cls and pred = cls) as tp,
  count(*) filter (truth <> cls and pred = cls) as fp, count(*) filter (truth = cls and pred <> cls) as fn
  from multiclass, (select truth as cls from multiclass union select pred from multiclass) c group by c.cls)"""))
def f1_avgs(spark, sf):
    return rounded(M.f1_averages(multiclass(spark, sf), "truth", "pred"), "f1_micro", "f1_macro", "f1_weighted", "mean_iou")


_CLASS_SCORES = {c: f"s{c}" for c in range(10)}


def _class_scored(spark, sf):
    """Scores per class from the first ten embedding entries."""
    df = load(spark, sf, "embeddings")
    return df.select("vec_id", F.col("label").alias("truth"), *[F.col("embedding")[c].cast("double").alias(s) for c, s in _CLASS_SCORES.items()])


@query("auc_multi", f"""
with x as (select label as truth, c.cls, cast(embedding[c.cls + 1] as double) as score, case when label = c.cls then 1 else 0 end as y
  from embeddings, (select unnest(range(10)) as cls) c),
per as (select cls, sum(y) as support, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0)
    / nullif(sum(y) * sum(1 - y), 0) as auc
  from ({sql_ranks('x', 'cls', {'rk': 'score'})}) group by cls),
micro as (select (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) as auc
  from ({sql_ranks('x', '', {'rk': 'score'})}))
select round(avg(auc), 6) as auc_macro, round(sum(auc * support) / sum(support), 6) as auc_weighted,
  round((select auc from micro), 6) as auc_micro from per""")
def auc_multi(spark, sf):
    return rounded(M.multiclass_auc(_class_scored(spark, sf), "truth", _CLASS_SCORES), "auc_macro", "auc_weighted", "auc_micro")


_E = "abs(True_value - Predicted_value)"


@query("losses", with_views("oof binary_scores", f"""
select a.*, b.* from (select round(avg({_E}), 6) as mae, round(avg({_E} * {_E}), 6) as mse,
  round(avg(pow(ln(1 + True_value) - ln(1 + Predicted_value), 2)), 6) as msle,
  round(100 * avg({_E} / greatest(abs(True_value), 1e-7)), 6) as mape_percent,
  round(avg(case when {_E} <= 1 then 0.5 * {_E} * {_E} else {_E} - 0.5 end), 6) as huber,
  round(avg({_E} + ln(1 + exp(-2 * {_E})) - ln(2)), 6) as log_cosh,
  round(avg(Predicted_value - True_value * ln(Predicted_value + 1e-7)), 6) as poisson,
  round(avg(abs((Predicted_value - True_value) / True_value)), 6) as relative_error from oof) a,
(select round(avg(greatest(1 - (case when truth = 0 then -1.0 else 1.0 end) * score, 0)), 6) as hinge,
  round(avg(pow(greatest(1 - (case when truth = 0 then -1.0 else 1.0 end) * score, 0), 2)), 6) as squared_hinge,
  round(avg(-(truth * ln(q) + (1 - truth) * ln(1 - q))), 6) as binary_crossentropy,
  round(avg(greatest(score, 0) - score * truth + ln(1 + exp(-abs(score)))), 6) as binary_crossentropy_logits
  from (select *, least(greatest(score, 1e-7), 1 - 1e-7) as q from binary_scores)) b"""))
def losses(spark, sf):
    first = ["mae", "mse", "msle", "mape_percent", "huber", "log_cosh", "poisson", "relative_error"]
    second = ["hinge", "squared_hinge", "binary_crossentropy", "binary_crossentropy_logits"]
    a = M.evaluate(oof(spark, sf), "True_value", "Predicted_value", first)
    b = M.evaluate(binary_scores(spark, sf), "truth", "score", second)
    both = a.select(*first, *[b.select(c).scalar().alias(c) for c in second])
    return rounded(both, *first, *second)


@query("vector_losses", """
with v as (select label, [case when label = i then 1.0 else 0.0 end for i in range(10)] as t,
    list_transform(range(10), lambda i: 1.0 / (1.0 + exp(-cast(embedding[i + 1] as double)))) as p from embeddings),
n as (select *, list_transform(p, lambda x: least(greatest(x / list_sum(p), 1e-7), 1 - 1e-7)) as q from v)
select round(avg(-ln(q[label + 1])), 6) as categorical_crossentropy,
  round(avg(-ln(least(greatest(p[label + 1], 1e-7), 1 - 1e-7))), 6) as sparse_categorical_crossentropy,
  round(avg(greatest(list_max([case when label = i then 0.0 else p[i + 1] end for i in range(10)]) - p[label + 1] + 1, 0)), 6) as categorical_hinge,
  round(avg(list_sum([greatest(t[i + 1], 1e-7) * ln(greatest(t[i + 1], 1e-7) / p[i + 1]) for i in range(10)])), 6) as kl_divergence,
  round(avg(p[label + 1] / sqrt(list_sum(list_transform(p, lambda x: x * x)))), 6) as cosine_similarity,
  round(avg(case when list_position(p, list_max(p)) = label + 1 then 1.0 else 0.0 end), 6) as categorical_accuracy,
  round(avg(case when len(list_filter(p, lambda x: x > p[label + 1])) < 5 then 1.0 else 0.0 end), 6) as top_5_accuracy,
  round(avg(list_sum([case when (p[i + 1] > 0.5) = (label = i) then 1.0 else 0.0 end for i in range(10)]) / 10), 6) as accuracy_thresh,
  round(avg(case when h.hit = 1 then 5 * (1 / (h.k + 1e-9)) * (1 / (1 + 1e-9)) / (4 / (h.k + 1e-9) + 1 / (1 + 1e-9) + 1e-9) else 0.0 end), 6) as fbeta
from (select *, {'hit': case when p[label + 1] > 0.5 then 1 else 0 end, 'k': len(list_filter(p, lambda x: x > 0.5))} as h from n)""")
def vector_losses(spark, sf):
    emb = load(spark, sf, "embeddings")
    idx = F.sequence(F.lit(0), F.lit(9))
    v = emb.select(
        "label",
        F.transform(idx, lambda i: F.when(F.col("label") == i, 1.0).otherwise(0.0)).alias("t"),
        F.transform(F.slice("embedding", 1, 10), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))).alias("p"),
    )
    t, p, label = F.col("t"), F.col("p"), F.col("label")
    return v.agg(
        r6(M.categorical_crossentropy(t, p)).alias("categorical_crossentropy"),
        r6(M.sparse_categorical_crossentropy(label, p)).alias("sparse_categorical_crossentropy"),
        r6(M.categorical_hinge(t, p)).alias("categorical_hinge"),
        r6(M.kl_divergence(t, p)).alias("kl_divergence"),
        r6(M.cosine_similarity(t, p)).alias("cosine_similarity"),
        r6(M.categorical_accuracy(t, p)).alias("categorical_accuracy"),
        r6(M.top_k_accuracy(5)(label, p)).alias("top_5_accuracy"),
        r6(M.threshold_accuracy(t, p, 0.5)).alias("accuracy_thresh"),
        r6(M.fbeta_samples(t, p, 2.0, 0.5)).alias("fbeta"),
    )


@query("threshold_metrics", with_views("binary_scores", """
select snapshot_id, round(max(case when tp / p_all >= 0.5 then tp / (tp + fp) end), 6) as precision_at_recall,
  round(max(case when tp / (tp + fp) >= 0.5 then tp / p_all end), 6) as recall_at_precision,
  round(max(case when 1 - fp / n_all >= 0.5 then tp / p_all end), 6) as sensitivity_at_specificity,
  round(max(case when tp / p_all >= 0.5 then 1 - fp / n_all end), 6) + 0.0 as specificity_at_sensitivity
from (select snapshot_id, tp, fp, nullif(p_all, 0) as p_all, nullif(n_all, 0) as n_all from w) group by snapshot_id""", _SCORES))
def threshold_metrics(spark, sf):
    out = M.operating_points(binary_scores(spark, sf), "truth", "score", 0.5, ["snapshot_id"])
    return rounded(out, *[c for c in out.columns if c != "snapshot_id"])


@query("named_metrics", with_views("binary_scores", """
select snapshot_id, count(*) as n, sum(f * y) as true_positives, sum(f * (1 - y)) as false_positives,
  sum((1 - f) * y) as false_negatives, sum((1 - f) * (1 - y)) as true_negatives,
  round(case when sum(f) = 0 then 0 else sum(f * y) / sum(f) end, 6) as precision, round(case when sum(y) = 0 then 0 else sum(f * y) / sum(y) end, 6) as recall,
  round(case when sum(f) + sum(y) = 0 then 0 else 2 * sum(f * y) / (sum(f) + sum(y)) end, 6) as f1,
  round(case when sum(2 - f - y) = 0 then 0 else 2 * sum((1 - f) * (1 - y)) / sum(2 - f - y) end, 6) as f1_neg,
  round((case when sum(f + y - f * y) = 0 then 0 else sum(f * y) / sum(f + y - f * y) end
    + case when sum(1 - f * y) = 0 then 0 else sum((1 - f) * (1 - y)) / sum(1 - f * y) end) / 2, 6) as mean_iou,
  round(avg(f), 6) as mean
from (select snapshot_id, cast(truth as double) as y, cast(case when score > 0.5 then 1 else 0 end as double) as f from binary_scores where truth is not null and score is not null)
group by snapshot_id"""))
def named_metrics(spark, sf):
    """Count metrics asked for by name."""
    df = binary_scores(spark, sf).filter("truth is not null and score is not null").withColumn("flag", F.when(F.col("score") > 0.5, 1).otherwise(0))
    names = ["true_positives", "false_positives", "false_negatives", "true_negatives", "precision", "recall", "f1", "f1_neg", "mean_iou", "mean"]
    return rounded(M.evaluate(df, "truth", "flag", names, ["snapshot_id"]), *names[4:])


@query("multilabel_auc", with_views("binary_scores", f"""
select label, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 6) as auc,
  cast(sum(y) as bigint) as positives
from ({sql_ranks('m', 'label', {'rk': 'score'})}) group by label""",
"m as (select 'quality' as label, truth as y, score from binary_scores union all select 'toxic', truth2, score from binary_scores)"))
def multilabel_auc(spark, sf):
    """Per-label ROC area of a two-label target."""
    df = binary_scores(spark, sf)
    cells = F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias("y"), F.col("score")) for n, c in (("quality", "truth"), ("toxic", "truth2"))])
    long = df.select(F.inline(cells))
    auc = M.roc_auc(long, "y", "score", ["label"])
    return rounded(auc.join(long.groupBy("label").agg(F.sum("y").alias("positives")), "label"), "auc")


@query("fold_metrics", with_views("oof", f"""
select Model, Label, fold, count(*) as n_test, round(avg({_E} * {_E}), 6) as mse, round({SMAPE_SQL}, 6) as smape,
  round({sql_corr('rt', 'rp')}, 6) + 0.0 as spearman,
  cast((select count(*) from orders) as bigint) - count(*) as n_train
from r group by Model, Label, fold""",
f"""f as (select *, cast(snapshot_id % 5 + 1 as int) as fold from oof),
r as ({sql_ranks('f', 'Model, Label, fold', {'rt': 'True_value', 'rp': 'Predicted_value'})})"""))
def fold_metrics(spark, sf):
    folded = oof(spark, sf).withColumn("fold", (F.col("snapshot_id") % 5 + 1).cast("int"))
    out = M.metrics_per_fold(folded, "True_value", "Predicted_value", "fold", ["mse", "smape", "spearman"], ["Model", "Label"])
    return rounded(out, "mse", "smape", "spearman")


@query("ref_means", with_views("predictions", """
select Model, round(avg(rho), 6) + 0.0 as mean_val from g where Label = 'stress_d' group by Model""", GROUPS_SQL))
def ref_means(spark, sf):
    subjects = agreement(predictions(spark, sf).filter("Label = 'stress_d'"), KEYS)
    return rounded(reference_means(subjects, ["Model"], "rho"), "mean_val")


@query("survey_scores", with_views("surveys", """
select snapshot_id, count(stress_d) as n, round(avg(stress_d), 6) as mean_label, count(*) - count(stress_d) as unlabelled
from surveys group by snapshot_id"""))
def survey_scores(spark, sf):
    out = surveys(spark, sf).groupBy("snapshot_id").agg(
        F.count("stress_d").alias("n"), F.avg("stress_d").alias("mean_label"),
        (F.count(F.lit(1)) - F.count("stress_d")).alias("unlabelled"),
    )
    return rounded(out, "mean_label")
