"""Models, ensembles and significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query, r6, rounded
from cohortline.catalog.tables import (
    GROUPS_SQL, binary_scores, daily_summary, demographics, load, oof, predictions, sql_corr, sql_ranks, sql_t_p, surveys, with_views,
)
from cohortline.functions import scalar as S
from cohortline.operators import ensemble as E
from cohortline.operators import forests
from cohortline.operators import models as L
from cohortline.operators import testing as T
from cohortline.operators.metrics import evaluate
from cohortline.operators.prep import resample
from cohortline.operators.rank import attach
from cohortline.operators.summary import agreement, fold_mean_with_zeros, five_numbers, second_level, weight_share

KEYS = ["snapshot_id", "Model", "Label"]


# --- ensembles -----------------------------------------------------------------

@query("feature_rho", "with " + ", ".join([
    "w as (select l_quantity as y, 'price' as feature, l_extendedprice as v from lineitem union all select l_quantity, 'discount', l_discount from lineitem "
    "union all select l_quantity, 'tax', l_tax from lineitem)",
    f"r as ({sql_ranks('w', 'feature', {'ra': 'v', 'rb': 'y'})})",
]) + f" select feature, count(*) as n_pairs, round({sql_corr('ra', 'rb')}, 6) + 0.0 as rho from r group by feature")
def feature_rho(spark, sf):
    li = load(spark, sf, "lineitem").select(
        "l_quantity", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")
    )
    return rounded(T.feature_label_rho(li, ["price", "discount", "tax"], "l_quantity"), "rho")


@query("stacking_join", with_views("binary_scores", """
select d.doc_id, d.n_chars, round(1 / (1 + exp(-b.score)), 6) as stacked from documents d left join binary_scores b on d.doc_id = b.id"""))
def stacking_join(spark, sf):
    earlier = binary_scores(spark, sf).select("id", S.sigmoid(F.col("score")).alias("yes_probability"))
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    out = E.stacked_feature(docs, earlier, "id", "yes_probability", "stacked")
    return rounded(out.withColumnRenamed("id", "doc_id"), "stacked")


_PROBS = """p as (select l_orderkey as id, l_linenumber as fold, l_discount as a, l_tax as b, 0.051237 as c from lineitem)"""


@query("ensemble_mean", with_views("", """
select id, round(a, 6) as a, round(b, 6) as b, round(c, 6) as c, folds,
  case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as predicted
from (select id, round(avg(a), 12) as a, round(avg(b), 12) as b, round(avg(cast(c as double)), 12) as c, count(*) as folds from p group by id)""", _PROBS))
def ensemble_mean(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), F.lit(0.051237).alias("c")
    )
    return rounded(E.fold_average(rows, ["id"], ["a", "b", "c"]), "a", "b", "c")


@query("product_ensemble", with_views("oof", """
select id, Model, Label, round(Predicted_value + 1e-9, 6) as Predicted_value from oof union all
select a.id, 'RFLR', a.Label, round(a.Predicted_value * b.Predicted_value / 2 + 1e-9, 6) from oof a join oof b on a.id = b.id and a.Label = b.Label
where a.Model = 'ElasticNet' and b.Model = 'RandomForestRegressor'"""))
def product_ensemble(spark, sf):
    df = oof(spark, sf).select("id", "Model", "Label", "Predicted_value")
    out = E.product_ensemble(df, "ElasticNet", "RandomForestRegressor")
    return out.withColumn("Predicted_value", F.round(F.col("Predicted_value") + 1e-9, 6))


@query("baseline_ensembles", with_views("oof", """
select e.Model, e.Label, count(*) as n, round(sum(e.Predicted_value), 3) as pred_total, sum(s.True_value) as true_total from
(select id, Model, Label, Predicted_value from oof union all
 select a.id, 'RFLR', a.Label, (a.Predicted_value + b.Predicted_value) / 2 from oof a join oof b on a.id = b.id and a.Label = b.Label
 where a.Model = 'ElasticNet' and b.Model = 'RandomForestRegressor') e
join (select id, True_value from oof where Label = 'stress_d' and Model = 'ElasticNet') s on e.id = s.id group by 1, 2"""))
def baseline_ensembles(spark, sf):
    out = E.with_baseline_ensembles(oof(spark, sf), "ElasticNet", "RandomForestRegressor", "stress_d", "stress_d_shuffled", combine="mean")
    return out.groupBy("Model", "Label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("Predicted_value"), 3).alias("pred_total"), F.sum("True_value").alias("true_total")
    )


@query("append_family", with_views("oof surveys", """
select id, snapshot_id, Model, Label, True_value, round(Predicted_value, 6) as Predicted_value, cast(null as varchar) as day from oof union all
select (select max(id) from oof) + row_number() over (order by id), snapshot_id, 'GRU', 'stress_d', stress_d, null, strftime(survey_date, '%Y-%m-%d') from surveys"""))
def append_family(spark, sf):
    base = oof(spark, sf).withColumn("day", F.lit(None).cast("string"))
    family = surveys(spark, sf).select(
        F.col("id").alias("key"), "snapshot_id", F.lit("GRU").alias("Model"), F.lit("stress_d").alias("Label"),
        F.col("stress_d").alias("True_value"), F.date_format("survey_date", "M/d/yyyy").alias("day"),
    )
    return rounded(E.append_family(base, family, ["key"], date="day"), "Predicted_value")


@query("hier_combine", """
select l_orderkey, l_linenumber, round(l_discount * l_tax + 0.5 * (1 - l_discount) * l_tax, 6) as soft,
  round(l_discount * round(l_quantity / 50) + 0.5 * (1 - l_discount) * round(l_quantity / 50), 6) as hard from lineitem""")
def hier_combine(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        r6(E.up_the_tree(F.col("l_discount"), [F.col("l_tax")])).alias("soft"),
        r6(E.up_the_tree(F.col("l_discount"), [F.col("l_quantity") / 50], hard=True)).alias("hard"),
    )


@query("child_rows", "select count(*) as n, sum(l_quantity) as total from lineitem where lower(l_returnflag) = 'a'")
def child_rows(spark, sf):
    rows = E.child_training_rows(load(spark, sf, "lineitem"), "l_returnflag", "A")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query("sigmoid_threshold", """
select vec_id, round(1 / (1 + exp(-cast(embedding[1] as double))), 6) as p, case when embedding[1] >= 0 then 1 else 0 end as flag,
  case when embedding[1] >= 0 then 0 else 1 end as other, cast(list_position(embedding, list_max(embedding)) - 1 as int) as top from embeddings""")
def sigmoid_threshold(spark, sf):
    x = F.col("embedding")[0].cast("double")
    flag = S.at_least(S.sigmoid(x), 0.5)
    return load(spark, sf, "embeddings").select(
        "vec_id", r6(S.sigmoid(x)).alias("p"), flag.alias("flag"), S.complement(flag).alias("other"), S.arg_max(F.col("embedding")).alias("top")
    )


# --- statistics ----------------------------------------------------------------

_WIDE = "(select snapshot_id, max(case when Label = 'stress_d' then {v} end) - max(case when Label = 'stress_d_shuffled' then {v} end) as d from g where Model = '{m}' group by snapshot_id)"


@query("paired_t", with_views("predictions", " union all ".join(
    f"""select '{m}' as Model, '{v}' as variable, count(d) as n, round(avg(d), 6) + 0.0 as mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) as t,
  cast(count(d) - 1 as double) as df from {_WIDE.format(v=v, m=m)}""" for m in ("ElasticNet", "MLP", "RandomForestRegressor") for v in ("rho", "smape")
), GROUPS_SQL))
def paired_t(spark, sf):
    """Label against shuffled label for every model and both metrics, from one pass."""
    subjects = agreement(predictions(spark, sf), KEYS)
    cells = F.array(*[
        F.struct(F.concat_ws("|", "Model", F.lit(v), "Label").alias("level"), F.col(v).alias("value")) for v in ("rho", "smape")
    ])
    long = subjects.select("snapshot_id", F.inline(cells))
    pairs = [(f"{m}|{v}|stress_d", f"{m}|{v}|stress_d_shuffled") for m in ("ElasticNet", "MLP", "RandomForestRegressor") for v in ("rho", "smape")]
    out = T.paired_t(long, "snapshot_id", "level", "value", pairs, p_value=False)
    parts = F.split("first", "[|]")
    return rounded(out.select(F.get(parts, F.lit(0)).alias("Model"), F.get(parts, F.lit(1)).alias("variable"), "n", "mean_diff", "t", "df"), "mean_diff", "t")


@query("one_sample_t", with_views("predictions", """
select Model, count(rho) as n, round(avg(rho), 6) + 0.0 as mean_diff, round(stddev_samp(rho), 6) as sd_diff,
  round(avg(rho) / (stddev_samp(rho) / sqrt(count(rho))), 6) + 0.0 as t, cast(count(rho) - 1 as double) as df from g where Label = 'stress_d' group by Model""", GROUPS_SQL))
def one_sample_t(spark, sf):
    subjects = agreement(predictions(spark, sf).filter("Label = 'stress_d'"), KEYS)
    return rounded(T.one_sample_t(subjects, "rho", keys=["Model"], p_value=False), "mean_diff", "sd_diff", "t")


@query("welch_t", with_views("predictions", """
select Model, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 as t,
  round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) as df from
(select Model, avg(rho) filter (Label = 'stress_d') as m1, avg(rho) filter (Label <> 'stress_d') as m2,
  var_samp(rho) filter (Label = 'stress_d') as v1, var_samp(rho) filter (Label <> 'stress_d') as v2,
  count(rho) filter (Label = 'stress_d') as n1, count(rho) filter (Label <> 'stress_d') as n2 from g group by Model)""", GROUPS_SQL))
def welch_t(spark, sf):
    subjects = agreement(predictions(spark, sf), KEYS)
    out = T.welch_t(subjects, "Label", "rho", [("stress_d", "stress_d_shuffled")], keys=["Model"], p_value=False)
    return out.select("Model", r6("t").alias("t"), F.round("df", 4).alias("df"))


@query("model_pairs", with_views("predictions", """
select first, second, n, round(md, 6) + 0.0 as mean_diff, round(sd, 6) as sd_diff, round(t, 6) + 0.0 as t, cast(dof as double) as df, round(p, 6) + 0.0 as p_value,
  round(md - q * sd / sqrt(n), 6) + 0.0 as ci_low, round(md + q * sd / sqrt(n), 6) + 0.0 as ci_high,
  round(least(max((m - k + 1) * p) over (order by k), 1), 6) + 0.0 as p_adj
from (select p.*, (lo + hi) / 2 as q, row_number() over (order by p, p.first, p.second) as k, count(*) over () as m
  from p join (select * from b where i = 60) using (first, second))""", GROUPS_SQL + f""",
w as (select snapshot_id, max(case when Model = 'ElasticNet' then rho end) as a, max(case when Model = 'MLP' then rho end) as b,
  max(case when Model = 'RandomForestRegressor' then rho end) as c from g where Label = 'stress_d' group by snapshot_id),
d as (select 'ElasticNet' as first, 'MLP' as second, a - b as diff from w union all select 'ElasticNet', 'RandomForestRegressor', a - c from w
  union all select 'MLP', 'RandomForestRegressor', b - c from w),
s as (select first, second, count(diff) as n, avg(diff) as md, stddev_samp(diff) as sd from d group by first, second),
p as (select *, {sql_t_p('t', 'dof')} as p from (select *, md / (sd / sqrt(n)) as t, n - 1 as dof from s)),
b as (select first, second, dof, 0.0::double as lo, 1000.0::double as hi, 0 as i from p
  union all select first, second, dof, case when {sql_t_p('((lo + hi) / 2)', 'dof')} > 0.05 then (lo + hi) / 2 else lo end,
    case when {sql_t_p('((lo + hi) / 2)', 'dof')} > 0.05 then hi else (lo + hi) / 2 end, i + 1 from b where i < 60)""").replace("with predictions", "with recursive predictions", 1))
def model_pairs(spark, sf):
    """All model pairs with Holm-adjusted p values; SQL finds the interval's quantile by halving."""
    subjects = agreement(predictions(spark, sf).filter("Label = 'stress_d'"), KEYS)
    tests = T.paired_t(subjects, "snapshot_id", "Model", "rho", T.all_pairs(["ElasticNet", "MLP", "RandomForestRegressor"]))
    return rounded(T.holm(tests), "mean_diff", "sd_diff", "t", "p_value", "p_adj", "ci_low", "ci_high")


@query("within_ols", with_views("surveys", """
select n, df, round(sxy / sxx, 6) + 0.0 as slope, round(sqrt((syy - sxy * sxy / sxx) / df / sxx), 6) as std_error,
  round(sxy / sxx / sqrt((syy - sxy * sxy / sxx) / df / sxx), 4) + 0.0 as t from
(select count(*) as n, count(*) - count(distinct snapshot_id) - 1 as df, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy from
 (select s.snapshot_id, f1 - avg(f1) over (partition by snapshot_id) as x, stress_d - avg(stress_d) over (partition by snapshot_id) as y
  from surveys s where stress_d is not null and f1 is not null))"""))
def within_ols(spark, sf):
    out = T.within_slope(surveys(spark, sf), "snapshot_id", "stress_d", "f1")
    return out.select("n", "df", r6("slope").alias("slope"), r6("std_error").alias("std_error"), (F.round("t", 4) + 0.0).alias("t"))


@query("within_ols_terms", with_views("surveys daily_summary", f"""
select term, round(estimate, 6) + 0.0 as estimate, round(std_error, 6) as std_error, cast(dof as double) as df, round(r2, 6) + 0.0 as r2,
  round(estimate / std_error, 6) + 0.0 as t, round({sql_t_p('(estimate / std_error)', 'dof')}, 6) + 0.0 as p_value
from (select term, estimate, sqrt(rss / dof * own) as std_error, dof, 1 - rss / yy as r2 from f,
  lateral (select * from (values ('f1', b1, i11), ('f2', b2, i22), ('avg_stress', b3, i33)) as v(term, estimate, own)))""", """
j as (select s.snapshot_id, s.stress_d, s.f1, s.f2, d.avg_stress from surveys s join daily_summary d on s.snapshot_id = d.snapshot_id and s.survey_date = d.survey_date
  where s.stress_d is not null and s.f1 is not null and s.f2 is not null and d.avg_stress is not null),
c as (select snapshot_id, stress_d - avg(stress_d) over w as y, f1 - avg(f1) over w as x1, f2 - avg(f2) over w as x2, avg_stress - avg(avg_stress) over w as x3
  from j window w as (partition by snapshot_id)),
m as (select count(*) - count(distinct snapshot_id) - 3 as dof, sum(x1 * x1) as a, sum(x1 * x2) as b, sum(x1 * x3) as c, sum(x2 * x2) as d, sum(x2 * x3) as e, sum(x3 * x3) as f,
  sum(x1 * y) as y1, sum(x2 * y) as y2, sum(x3 * y) as y3, sum(y * y) as yy from c),
i as (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) as det from m),
k as (select *, (d * f - e * e) / det as i11, (a * f - c * c) / det as i22, (a * d - b * b) / det as i33, (c * e - b * f) / det as i12, (b * e - c * d) / det as i13, (b * c - a * e) / det as i23 from i),
h as (select *, i11 * y1 + i12 * y2 + i13 * y3 as b1, i12 * y1 + i22 * y2 + i23 * y3 as b2, i13 * y1 + i23 * y2 + i33 * y3 as b3 from k),
f as (select *, yy - b1 * y1 - b2 * y2 - b3 * y3 as rss from h)"""))
def within_ols_terms(spark, sf):
    """Within-subject regression on a prediction and two covariates (re-aimed mixed model)."""
    s = surveys(spark, sf).join(daily_summary(spark, sf), ["snapshot_id", "survey_date"])
    out = T.within_subject_ols(s.select("snapshot_id", "stress_d", "f1", "f2", "avg_stress"), "snapshot_id", "stress_d", ["f1", "f2", "avg_stress"])
    return rounded(out, "estimate", "std_error", "t", "p_value", "r2")


@query("ols_line", """
select 'price' as term, round(regr_slope(l_quantity, l_extendedprice / 1000), 6) as estimate, cast(count(*) - 2 as double) as df,
  round(sqrt((regr_syy(l_quantity, l_extendedprice / 1000) - regr_sxy(l_quantity, l_extendedprice / 1000) * regr_slope(l_quantity, l_extendedprice / 1000)) / (count(*) - 2) / regr_sxx(l_quantity, l_extendedprice / 1000)), 6) as std_error,
  round(regr_r2(l_quantity, l_extendedprice / 1000), 6) as r2 from lineitem""")
def ols_line(spark, sf):
    li = load(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    out = T.ols(li, "l_quantity", ["price"]).filter("term = 'price'")
    return rounded(out.select("term", "estimate", "df", "std_error", "r2"), "estimate", "std_error", "r2")


@query("ols_factors", """
select 'c_mktsegment_' || c_mktsegment as term, round(avg(c_acctbal) - (select avg(c_acctbal) from customer where c_mktsegment = 'BUILDING'), 4) as estimate
from customer where c_mktsegment <> 'BUILDING' group by c_mktsegment""")
def ols_factors(spark, sf):
    """With only factor terms each estimate is a difference from the reference level's mean."""
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    df = T.reference_dummies(load(spark, sf, "customer"), "c_mktsegment", "BUILDING", levels)
    out = T.ols(df, "c_acctbal", [f"c_mktsegment_{v}" for v in levels if v != "BUILDING"])
    return out.filter("term <> '(Intercept)'").select("term", F.round("estimate", 4).alias("estimate"))


@query("standardised_slope", """select 'price' as term, round(corr(l_quantity, l_extendedprice), 6) as estimate from lineitem""")
def standardised_slope(spark, sf):
    """A standardised slope on one feature equals the correlation."""
    li = load(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("price"))
    out = T.ols(T.standardised(li, ["l_quantity", "price"]), "l_quantity", ["price"]).filter("term = 'price'")
    return rounded(out.select("term", "estimate"), "estimate")


_DEVICE = f"""j as (select s.snapshot_id, s.stress_d, s.f1, s.f2, d.avg_stress from surveys s left join daily_summary d
  on s.snapshot_id = d.snapshot_id and s.survey_date = d.survey_date),
x as (select snapshot_id, 'rho.model' as variable, stress_d as a, f1 as b from j union all select snapshot_id, 'rho.device', stress_d, avg_stress from j
  union all select snapshot_id, 'rho.hrv', -stress_d, f2 from j),
y as (select * from x where a is not null and b is not null),
r as ({sql_ranks('y', 'snapshot_id, variable', {'ra': 'a', 'rb': 'b'})}),
v as (select snapshot_id, variable, {sql_corr('ra', 'rb')} as value from r group by snapshot_id, variable)"""


@query("device_vs_model", with_views("surveys daily_summary", """
select k.variable, count(*) as subjects, round(avg(v.value), 6) + 0.0 as value_mn, round(stddev_samp(v.value), 6) as value_sd
from (select distinct snapshot_id, variable from x) k left join v on k.snapshot_id = v.snapshot_id and k.variable = v.variable group by k.variable""", _DEVICE))
def device_vs_model(spark, sf):
    joined = surveys(spark, sf).join(daily_summary(spark, sf), ["snapshot_id", "survey_date"], "left")
    rho = T.rho_comparison(joined, ["snapshot_id"], "stress_d", {"rho.model": "f1", "rho.device": "avg_stress", "rho.hrv": "-f2"})
    return rounded(second_level(rho, ["variable"], ["value"]), "value_mn", "value_sd")


# --- models --------------------------------------------------------------------

def _regression_rows(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("snapshot_id"),
        F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("price"), "l_discount", "l_tax",
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("fold"),
    )


@query("oof_linear", """
with d as (select l_orderkey * 10 + l_linenumber as id, l_quantity as y, l_extendedprice / 1000 as x, cast(l_suppkey % 5 + 1 as int) as fold from lineitem),
k as (select distinct fold from d),
m as (select k.fold, regr_slope(y, x) as b, regr_intercept(y, x) as a from k join d on d.fold <> k.fold group by k.fold)
select d.fold, count(*) as n, round(sum(m.a + m.b * d.x), 2) as pred_total, round(avg(pow(d.y - m.a - m.b * d.x, 2)), 5) as mse from d join m on d.fold = m.fold group by d.fold""")
def oof_linear(spark, sf):
    """Out-of-fold least squares on one standardised feature."""
    df = _regression_rows(spark, sf).select("id", "y", "price", "fold")
    run = L.cross_validate(df, "fold", range(1, 6), "id", "y", L.preparation(["price"]), "LinearRegression")
    gap = F.col("True_value") - F.col("Predicted_value")
    return run.predictions.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("Predicted_value"), 2).alias("pred_total"), F.round(F.avg(gap * gap), 5).alias("mse")
    )


@query("oof_once", with_views("", "select count(*) as n, count(distinct o_orderkey) as ids, 1 as most from orders"))
def oof_once(spark, sf):
    """A forest's out-of-fold table holds every row once."""
    df = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") % 7).cast("double").alias("a"),
        F.month("o_orderdate").cast("double").alias("b"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("fold"),
    )
    run = L.cross_validate(df, "fold", range(1, 6), "id", "y", L.preparation(["a", "b"]), "RandomForestRegressor", {"n_estimators": 5, "max_depth": 4})
    keyed = run.predictions.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    return keyed.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("ids"), F.max("c").alias("most"))


@query("nested_elastic_net")
def nested_elastic_net(spark, sf):
    """Grid search with subject-safe inner folds; scores of every fold's best set."""
    df, features = _regression_rows(spark, sf), ["price", "l_discount", "l_tax"]
    grid = L.parameter_grid({"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.6, 0.7, 0.8, 0.9, 0.95, 0.99]})
    run = L.nested_cross_validate(
        df, "fold", range(1, 6), "id", "y", L.preparation(features), "ElasticNet", grid, "spearman",
        inner_k=5, group="snapshot_id", from_sums=features,
    )
    scores = evaluate(run.predictions, "True_value", "Predicted_value", ["mse", "smape", "spearman"], ["fold"])
    best = L.tuning_table(df, run).filter("best").select("fold", F.col("params")["alpha"].alias("alpha"), F.col("params")["l1_ratio"].alias("l1_ratio"))
    return rounded(scores.join(best, "fold"), "mse", "smape", "spearman")


@query("importance_shares")
def importance_shares(spark, sf):
    """Forest importances per fold, averaged over folds, as ranked shares."""
    df = _regression_rows(spark, sf)
    names = ["price", "l_discount", "l_tax"]
    per_fold = forests.fold_importances(df, "fold", range(1, 6), "id", "y", names, trees=10, depth=5)
    return rounded(weight_share(fold_mean_with_zeros(per_fold, ["feature"], "weight", 5, "weight"), "feature", "weight"), "share")


def _class_rows(spark, sf):
    emb = load(spark, sf, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("y"), F.col("label").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)], (F.col("vec_id") % 3 + 1).cast("int").alias("fold"),
    )


_CLASSIFIERS = {
    "DecisionTreeClassifier": {"max_depth": 5}, "RandomForestClassifier": {"n_estimators": 10, "max_depth": None},
    "GradientBoostingClassifier": {"max_iter": 5}, "LogisticRegression": {"max_iter": 50}, "LinearSVC": {"max_iter": 20},
}


@query("classifier_scores")
def classifier_scores(spark, sf):
    """Out-of-fold scores of every classifier on two halves of the embedding labels."""
    df, names = _class_rows(spark, sf), [f"e{i}" for i in range(64)]
    out = None
    for run in L.cross_validate_each(df, "fold", [1, 2, 3], "id", "y", L.preparation(names), _CLASSIFIERS, classes=["no", "yes"]).values():
        rows = run.predictions.select("id", "Model", "True_value", "Predicted_value")
        out = rows if out is None else out.unionByName(rows)
    scores = evaluate(out, "True_value", "Predicted_value", ["accuracy", "f1_macro"], ["Model"])
    return rounded(scores, "accuracy", "f1_macro")


@query("multiclass_tree")
def multiclass_tree(spark, sf):
    """Ten-class tree with one probability column per class."""
    df, names = _class_rows(spark, sf), [f"e{i}" for i in range(64)]
    run = L.cross_validate(df, "fold", [1, 2, 3], "id", "label", L.preparation(names), "DecisionTreeClassifier", {"max_depth": 8}, classes=[str(c) for c in range(10)])
    return rounded(run.predictions, "Predicted_value", *[f"{c}_probability" for c in range(10)])


@query("external_scoring", "select vec_id as id, 3 as folds, true as proper from embeddings")
def external_scoring(spark, sf):
    """Every fold's model scores all rows; averaged probabilities stay proper."""
    df, names = _class_rows(spark, sf), [f"e{i}" for i in range(64)]
    run = L.cross_validate(df, "fold", [1, 2, 3], "id", "y", L.preparation(names), "LogisticRegression", {"max_iter": 20})
    scored = L.score_external(df, run.models, "id", ["no", "yes"])
    mean = E.fold_average(scored, ["id"], ["no_probability", "yes_probability"])
    proper = F.abs(F.col("no_probability") + F.col("yes_probability") - 1) < 1e-9
    return mean.select("id", F.col("folds").cast("int").alias("folds"), proper.alias("proper"))


@query("learning_curve")
def learning_curve(spark, sf):
    df, features = _regression_rows(spark, sf), ["price", "l_discount", "l_tax"]
    out = L.learning_curve(df, "fold", [1, 2, 3, 4, 5], "id", "y", L.preparation(features), "LinearRegression", "rmse", from_sums=features)
    return rounded(out, "score_mean", "score_sd")


@query("balanced_bagging", with_views("binary_scores", "select id, true as proper from binary_scores"))
def balanced_bagging(spark, sf):
    df = binary_scores(spark, sf).withColumn("s2", F.col("score") * F.col("score"))
    out = L.balanced_bagging(df, df, "id", "truth", L.preparation(["score", "s2"]), "LogisticRegression", ["no", "yes"], bags=3, params={"max_iter": 20})
    return out.select("id", (F.abs(F.col("no_probability") + F.col("yes_probability") - 1) < 1e-9).alias("proper"))


@query("smote_sizes", with_views("", """
select y, (select max(n) from (select count(*) as n from d group by y)) as n from (select distinct y from d)""",
"d as (select case when label >= 7 then 1 else 0 end as y from embeddings)"))
def smote_sizes(spark, sf):
    df = load(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") >= 7).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    )
    filled = resample(df, "y", "vec_id", "smote", features=[f"e{i}" for i in range(64)])
    return filled.groupBy("y").agg(F.count_distinct("vec_id").alias("n"))


@query("repeated_forests")
def repeated_forests(spark, sf):
    """Mean importance of demographics for the subject's mean prediction over seeds."""
    subjects = agreement(predictions(spark, sf).filter("Label = 'stress_d' and Model = 'RandomForestRegressor'"), KEYS)
    merged = subjects.join(demographics(spark, sf), "snapshot_id").withColumn("lang", F.col("lang").cast("double"))
    weights, fit = L.repeated_forests(merged.select("true_mn", "n", "age", "lang"), ["n", "age", "lang"], "true_mn", repeats=1000)
    return rounded(weights.withColumn("rho_median", fit.select("median").scalar()), "importance", "rho_median")


@query("text_naive_bayes", r"""
with d as (select doc_id as id, cast(doc_id % 3 + 1 as int) as fold, quality as y, text from documents join labels using (doc_id) where quality in (0, 1)),
tk as (select id, fold, y, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}+'))) as word from d),
f as (select id, word, count(*) as tf from tk group by id, word),
c as (select word, fold, y, count(*) as n from tk group by word, fold, y),
k as (select unnest(range(1, 4)) as k),
w as (select k, word, coalesce(sum(n) filter (y = 0), 0) as n0, coalesce(sum(n) filter (y = 1), 0) as n1 from k join c on c.fold <> k group by k, word),
t as (select k, count(*) as v, sum(n0) as s0, sum(n1) as s1 from w group by k),
p as (select k, count(*) as n, count(*) filter (y = 0) as r0, count(*) filter (y = 1) as r1 from k join d on d.fold <> k group by k),
s as (select d.id, d.fold, d.y, ln(any_value(r0) + 1) + coalesce(sum(tf * (ln(n0 + 1) - ln(s0 + v))), 0) as a0, ln(any_value(r1) + 1) + coalesce(sum(tf * (ln(n1 + 1) - ln(s1 + v))), 0) as a1
  from d join p on p.k = d.fold left join f on f.id = d.id left join w on w.k = d.fold and w.word = f.word left join t on t.k = w.k group by d.id, d.fold, d.y),
g as (select *, case when a1 > a0 then 1 else 0 end as p from s),
m as (select fold, count(*) as n, avg(cast(p = y as int)) as accuracy, count(*) filter (y = 1) as n1, count(*) filter (p = 1 and y = 1) as t1, count(*) filter (p <> y) as wrong,
  count(*) filter (p = 0 and y = 0) as t0 from g group by fold)
select fold, n, round(accuracy, 6) as accuracy,
  round((n1 * coalesce(2.0 * t1 / nullif(2 * t1 + wrong, 0), 0) + (n - n1) * coalesce(2.0 * t0 / nullif(2 * t0 + wrong, 0), 0)) / n, 6) as f1_weighted from m""")
def text_naive_bayes(spark, sf):
    """Multinomial naive Bayes on word counts of labelled documents, from one table of counts by word, fold and class."""
    from cohortline.operators.naive_bayes import out_of_fold
    from cohortline.operators.text import words

    docs = load(spark, sf, "documents").select("doc_id", "text").join(load(spark, sf, "labels"), "doc_id")
    df = docs.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), words(F.lower("text")).alias("words"), (F.col("doc_id") % 3 + 1).cast("int").alias("fold"))
    rows = out_of_fold(df, "id", "y", "words", "fold", [0, 1])
    return rounded(evaluate(rows, "y", "Predicted_value", ["accuracy", "f1_weighted"], ["fold"]), "accuracy", "f1_weighted")
