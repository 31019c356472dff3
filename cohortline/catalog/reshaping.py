"""Row edits, joins, reshaping and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query, r6, rounded
from cohortline.catalog.tables import (
    GROUPS_SQL, daily_summary, demographics, folds_wide, load, oof, predictions, surveys, with_views,
)
from cohortline.functions import scalar as S
from cohortline.operators import ensemble as E
from cohortline.operators import rows as R
from cohortline.operators import summary as D
from cohortline.operators.folds import folds_from_wide
from cohortline.operators.rank import attach

KEYS = ["snapshot_id", "Model", "Label"]
MODELS = ["ElasticNet", "MLP", "RandomForestRegressor"]
LABELS = ["stress_d", "stress_d_shuffled"]


@query("covariate_join", with_views("surveys daily_summary demographics", """
select s.id, s.snapshot_id, s.stress_d, round(d.avg_stress, 6) as avg_stress, g.lang, g.cohort, round(g.age, 6) as age
from surveys s left join daily_summary d on s.snapshot_id = d.snapshot_id and s.survey_date = d.survey_date
join demographics g on s.snapshot_id = g.snapshot_id"""))
def covariate_join(spark, sf):
    s = surveys(spark, sf).select("id", "snapshot_id", "survey_date", "stress_d")
    joined = attach(attach(s, daily_summary(spark, sf), ["snapshot_id", "survey_date"], "left"), demographics(spark, sf), ["snapshot_id"])
    return rounded(joined.drop("survey_date"), "avg_stress", "age")


@query("semi_subjects", with_views("predictions demographics", """
select count(*) as n, count(distinct snapshot_id) as subjects from predictions
where snapshot_id in (select snapshot_id from demographics where age > 5000)"""))
def semi_subjects(spark, sf):
    older = demographics(spark, sf).filter("age > 5000").select("snapshot_id")
    kept = predictions(spark, sf).select("snapshot_id").join(older, "snapshot_id", "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("snapshot_id").alias("subjects"))


@query("in_list", with_views("surveys", """
select id, snapshot_id, stress_d, f1, f2, f3 from surveys
where stress_d in (1, 3, 5) and f3 in ('click', 'view') and f2 is not null"""))
def in_list(spark, sf):
    df = R.drop_unlabelled(surveys(spark, sf), "stress_d")
    df = R.in_list_filters(df, {"stress_d": [1.0, 3.0, 5.0], "f3": ["click", "view"]})
    return R.project(R.complete_cases(df, ["f1", "f2"]), ["id", "snapshot_id", "stress_d", "f1", "f2", "f3"])


@query("null_rows", with_views("surveys", """
select id, coalesce(zipcode, 0) as zipcode, coalesce(stress_d, 0) as stress_d, coalesce(f2, 0) as f2
from surveys where zipcode is not null or stress_d is not null or f2 is not null"""))
def null_rows(spark, sf):
    kept = R.drop_all_null(surveys(spark, sf).select("id", "zipcode", "stress_d", "f2"), ["zipcode", "stress_d", "f2"])
    return R.fill_constants(kept, number=0)


@query("fold_weights", with_views("", """
select feature, round(sum(w) / 5.0, 6) as mean from
(select l_returnflag || l_linestatus || cast(l_linenumber as varchar) as feature, l_suppkey % 5 as fold, avg(l_discount) as w
 from lineitem where l_quantity > 25 or l_suppkey % 5 < 3 group by 1, 2) group by feature"""[1:]))
def fold_weights(spark, sf):
    li = load(spark, sf, "lineitem").filter((F.col("l_quantity") > 25) | (F.col("l_suppkey") % 5 < 3))
    per_fold = li.groupBy(
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("feature"), (F.col("l_suppkey") % 5).alias("fold")
    ).agg(F.avg("l_discount").alias("w"))
    return rounded(D.fold_mean_with_zeros(per_fold, ["feature"], "w", 5), "mean")


_NAMES = [f"{m}_{l}" for m in MODELS for l in LABELS]


@query("wide_cast", with_views("predictions", "select snapshot_id, " + ", ".join(
    f"round(max(case when Model || '_' || Label = '{n}' then {v} end), 6) + 0.0 as {v}_{n}" for v in ("smape", "rho") for n in _NAMES
) + " from g group by snapshot_id", GROUPS_SQL))
def wide_cast(spark, sf):
    subjects = D.agreement(predictions(spark, sf), KEYS)
    wide = D.wide_cast(subjects, "snapshot_id", ["Model", "Label"], _NAMES, ["smape", "rho"])
    return rounded(wide, *[c for c in wide.columns if c != "snapshot_id"])


@query("melt", with_views("predictions", """
select snapshot_id, Model, Label, variable, count(*) as n, round(sum(value) + 1e-7, 4) as total from
(select snapshot_id, Model, Label, 'True_value' as variable, True_value as value from predictions union all
 select snapshot_id, Model, Label, 'Predicted_value', Predicted_value from predictions) group by snapshot_id, Model, Label, variable"""))
def melt(spark, sf):
    long = D.melt(predictions(spark, sf), KEYS, ["True_value", "Predicted_value"])
    out = long.groupBy(*KEYS, "variable").agg(F.count(F.lit(1)).alias("n"), (F.sum("value") + 1e-7).alias("total"))
    return out.withColumn("total", F.round("total", 4))


@query("crosstab", with_views("predictions", """
select Model, count(*) filter (Label = 'stress_d') as stress_d, count(*) filter (Label = 'stress_d_shuffled') as stress_d_shuffled
from predictions group by Model"""))
def crosstab(spark, sf):
    return D.contingency(predictions(spark, sf), "Model", "Label", LABELS)


@query("hist", with_views("predictions", """
select Label, bin, round(bin * cast(0.05 as double), 6) + 0.0 as center, n, round(n / sum(n) over (partition by Label), 6) as share from
(select Label, cast(floor(rho / 0.05 + 0.5) as bigint) as bin, count(*) as n from g where rho is not null group by 1, 2)""", GROUPS_SQL))
def hist(spark, sf):
    subjects = D.agreement(predictions(spark, sf), KEYS)
    return rounded(D.histogram(subjects, ["Label"], "rho", 0.05), "center", "share")


@query("box", with_views("predictions", """
select q.Model, q.Label, count(*) as n, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3,
  round(min(case when v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then v end), 6) as low,
  round(max(case when v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then v end), 6) as high,
  count(*) filter (not v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers
from q join e on q.Model = e.Model and q.Label = e.Label group by q.Model, q.Label""",
"""e as (select Model, Label, abs(True_value - Predicted_value) as v from predictions),
q as (select Model, Label, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from e group by Model, Label)"""))
def box(spark, sf):
    """Box of the absolute error."""
    err = predictions(spark, sf).withColumn("v", F.abs(F.col("True_value") - F.col("Predicted_value")))
    return rounded(D.box_stats(err, ["Model", "Label"], "v"), "q1", "median", "q3", "low", "high")


@query("above_baseline", with_views("predictions", """
select Model, count(*) filter (rho > b) as n_above, count(*) as n, round(count(*) filter (rho > b) / count(*), 6) as share
from g, (select avg(rho) as b from g where Model = 'RandomForestRegressor' and Label = 'stress_d_shuffled')
where Label = 'stress_d' group by Model""", GROUPS_SQL))
def above_baseline(spark, sf):
    subjects = D.agreement(predictions(spark, sf), KEYS)
    base = subjects.filter("Model = 'RandomForestRegressor' and Label = 'stress_d_shuffled'").agg(F.avg("rho").alias("b"))
    return rounded(D.share_above(subjects.filter("Label = 'stress_d'"), ["Model"], "rho", base), "share")


@query("align_union", with_views("predictions surveys", """
select id, snapshot_id, Model, round(Predicted_value, 6) as Predicted_value from predictions union all
select id, snapshot_id, null, null from surveys"""))
def align_union(spark, sf):
    first = predictions(spark, sf).select("id", "snapshot_id", "Model", "Predicted_value")
    return rounded(R.align_union(first, surveys(spark, sf)), "Predicted_value")


@query("first_per_key", """
select user_id, event_id, event_type, value from
(select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1""")
def first_per_key(spark, sf):
    ev = load(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return R.first_per_key(ev, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("masked_update", with_views("oof", """
select o.id, o.Model, o.Label, case when o.Label = 'stress_d_shuffled' then s.True_value else o.True_value end as True_value
from oof o left join (select id, Model, True_value from oof where Label = 'stress_d') s on o.id = s.id and o.Model = s.Model"""))
def masked_update(spark, sf):
    out = R.copy_value_between_labels(oof(spark, sf), ["Model", "id"], "Label", "True_value", "stress_d", "stress_d_shuffled")
    return out.select("id", "Model", "Label", "True_value")


@query("relabel", with_views("predictions", """
select case Model when 'ElasticNet' then 'Elastic Net' when 'MLP' then 'Multilayer Perceptron' else Model end as Model,
  case when Label like '%shuffle%' then 'shuffled' else 'actual' end as kind, source, count(*) as n
from predictions, (values ('RegularFeatureInput'), ('TextFeatureInput')) s(source) group by 1, 2, 3"""))
def relabel(spark, sf):
    names = spark.sql("select * from values ('ElasticNet', 'Elastic Net'), ('MLP', 'Multilayer Perceptron') as t(old, new)")
    counts = predictions(spark, sf).groupBy("Model", "Label").agg(F.count(F.lit(1)).alias("n"))
    renamed = R.relabel(counts, "Model", names).withColumn("kind", S.label_from_path(F.col("Label"), [("shuffle", "shuffled")], "actual"))
    grid = renamed.withColumn("source", F.explode(F.array(F.lit("RegularFeatureInput"), F.lit("TextFeatureInput"))))
    return grid.groupBy("Model", "kind", "source").agg(F.sum("n").alias("n"))


@query("run_grid", """
select m.l_returnflag as Model, l.Label, s.Feature_source from (select distinct l_returnflag from lineitem) m,
(values ('stress_d'), ('stress_d_shuffled')) l(Label), (values ('all'), ('no_context')) s(Feature_source)""")
def run_grid(spark, sf):
    models = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("Model")).distinct()
    return D.run_grid(models, LABELS, ["all", "no_context"])


@query("best_per_label", with_views("predictions", """
select Label, Model, n, round(rho_mn, 6) + 0.0 as rho_mn from (select *, row_number() over (partition by Label order by rho_mn desc, Model) as k from
(select Label, Model, count(*) as n, avg(rho) as rho_mn from g group by Label, Model)) where k = 1""", GROUPS_SQL))
def best_per_label(spark, sf):
    scores = D.second_level(D.agreement(predictions(spark, sf), KEYS), ["Label", "Model"], ["rho"])
    best = D.best_per_group(scores.select("Label", "Model", F.col("subjects").alias("n"), "rho_mn"), ["Label"], "rho_mn", ["Model"])
    return rounded(best, "rho_mn")


@query("weight_share", """
select p_name, round(abs(w) / sum(abs(w)) over (), 9) as share, row_number() over (order by abs(w) desc, p_name) as rank
from (select p_name, sum(p_retailprice - 1000 * p_size) as w from part group by p_name)""")
def weight_share(spark, sf):
    weights = load(spark, sf, "part").withColumn("w", F.col("p_retailprice") - 1000 * F.col("p_size"))
    shares = D.weight_share(D.collapse_duplicates(weights, "p_name", "w"), "p_name", "w")
    return shares.withColumn("share", F.round("share", 9))


@query("top_features", """
select p_name, n from (select p_name, count(*) as n from part group by p_name) order by n desc, p_name limit 15""")
def top_features(spark, sf):
    counts = load(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return D.top_k(counts, ["n", "p_name"], 15)


@query("restore_order", with_views("folds_wide", """
select row_id, fold, position, fold * 1000000 + position as prediction from
(select Fold1_test as row_id, cast(1 as int) as fold, pos as position from folds_wide union all select Fold2_test, 2, pos from folds_wide)
where row_id is not null"""))
def restore_order(spark, sf):
    folds = folds_from_wide(folds_wide(spark, sf), 2)
    test = folds.filter("split = 'test'")
    files = test.select("fold", "position", (F.col("fold") * 1000000 + F.col("position")).alias("prediction"))
    return E.restore_order(folds, files).select("row_id", "fold", "position", "prediction")


@query("flatten", """
select vec_id, """ + ", ".join(f"embedding[{i + 1}] as embedding_{i}" for i in range(8)) + " from embeddings")
def flatten(spark, sf):
    return R.flatten_arrays(load(spark, sf, "embeddings").select("vec_id", "embedding"), {"embedding": 8})


@query("id_offset", with_views("predictions surveys", """
select 'MLP' as Model_new, snapshot_id, row_number() over (order by id) + (select max(id) from predictions) as id_new from surveys"""))
def id_offset(spark, sf):
    top = predictions(spark, sf).agg((F.max("id") + 1).alias("m")).scalar()
    s = surveys(spark, sf).select("snapshot_id", F.col("id").alias("key"))
    tagged = R.tag(R.assign_ids(s, ["key"], "id", top).drop("key"), Model="MLP")
    return R.suffix_columns(tagged, "_new", keep=["snapshot_id"])


@query("name_parts", """
select c_custkey, split_part(c_name, '#', 1) as kind, cast(split_part(c_name, '#', 2) as bigint) as number, lower(c_mktsegment) as segment,
  contains(c_mktsegment, 'A') as has_a, regexp_replace(c_mktsegment, '^MACHINERY$', 'Machines') as relabelled,
  coalesce(try_cast(c_name as double), 0.0) as as_number, case when c_acctbal <= 0 then 0 else 1 end as positive,
  lpad(cast(c_custkey as varchar), 5, '0') as zip, c_name || '_' || c_mktsegment as joined from customer""")
def name_parts(spark, sf):
    c = load(spark, sf, "customer")
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return c.select(
        "c_custkey",
        F.split_part(name, F.lit("#"), F.lit(1)).alias("kind"),
        F.split_part(name, F.lit("#"), F.lit(2)).cast("long").alias("number"),
        F.lower(seg).alias("segment"),
        seg.contains("A").alias("has_a"),
        F.regexp_replace(seg, "^MACHINERY$", "Machines").alias("relabelled"),
        S.number_or_zero(name).alias("as_number"),
        S.positive_flag(F.col("c_acctbal").cast("string")).alias("positive"),
        S.zip_text(F.col("c_custkey")).alias("zip"),
        F.concat_ws("_", name, seg).alias("joined"),
    )


@query("date_format", """
select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%d.%m.%Y') as text from events""")
def date_format(spark, sf):
    ev = load(spark, sf, "events").select("event_id", F.date_format("ts", "M/d/yyyy").alias("us"))
    return ev.select("event_id", S.reformat_date(F.col("us")).alias("day"), S.reformat_date(F.col("us"), "M/d/yyyy", "dd.MM.yyyy").alias("text"))


@query("params_join", with_views("oof", """
select r.fold, round(mse, 6) as mse, n, 10 * r.fold as max_depth from
(select cast(snapshot_id % 5 + 1 as int) as fold, avg(pow(True_value - Predicted_value, 2)) as mse, count(*) as n from oof group by 1) r"""))
def params_join(spark, sf):
    folded = oof(spark, sf).withColumn("fold", (F.col("snapshot_id") % 5 + 1).cast("int"))
    gap = F.col("True_value") - F.col("Predicted_value")
    results = folded.groupBy("fold").agg(F.avg(gap * gap).alias("mse"), F.count(F.lit(1)).alias("n"))
    params = folded.select("fold").distinct().withColumn("max_depth", F.col("fold") * 10)
    return rounded(E.results_with_parameters(results, params), "mse")


@query("shuffled_rows", """select count(*) as n, count(distinct o_orderkey) as keys, sum(o_custkey) as checksum from orders""")
def shuffled_rows(spark, sf):
    """A seeded reordering keeps every row."""
    mixed = R.shuffled(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 7)
    return mixed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_custkey").alias("checksum"))
