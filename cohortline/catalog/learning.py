"""Learning from sums, counts and blocks, with SQL twins that compute the same values."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cohortline.catalog.registry import query, r6, rounded
from cohortline.catalog.tables import binary_scores, demographics, load, oof, predictions, surveys, with_views, zip_zones
from cohortline.functions import scalar as S
from cohortline.operators import blocks as B
from cohortline.operators import forests, hierarchy
from cohortline.operators import models as L
from cohortline.operators import moments as M
from cohortline.operators import prep as P
from cohortline.operators import rows as R
from cohortline.operators import text as X
from cohortline.operators.baseline import shuffle_train_labels
from cohortline.operators.ensemble import tagged
from cohortline.operators.folds import folds_for_labels
from cohortline.operators.metrics import evaluate
from cohortline.operators.smote import minority_neighbours
from cohortline.operators.summary import agreement
from cohortline.operators.timezones import correct_local_times
from cohortline.operators.windows import sliding_windows

#: The study's grid: alpha, l1_ratio.
GRID = [(a, r) for a in (0.01, 0.1, 1.0) for r in (0.6, 0.7, 0.8, 0.9, 0.95, 0.99)]

_LINES = """d as (select l_orderkey, l_linenumber, l_quantity as y, l_extendedprice / 1000 as x, l_discount as x2, l_returnflag, l_linestatus,
  cast(l_suppkey % 5 + 1 as int) as fold, cast(l_orderkey % 5 + 1 as int) as inner_fold from lineitem)"""


def _lines(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey"), "l_linenumber", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("x"),
        F.col("l_discount").alias("x2"), "l_returnflag", "l_linestatus",
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("fold"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("inner_fold"),
    )


# --- fits from sums --------------------------------------------------------------

@query("elastic_net_path", with_views("", """
select k as fold, alpha, l1_ratio, round(slope, 6) + 0.0 as slope, round(score, 5) as score, round(mse, 5) as mse from
(select c.k, c.alpha, c.l1_ratio, c.b / c.s as slope, c.score, avg(pow(d.y - c.ym - c.b * (d.x - c.m) / c.s, 2)) as mse
 from chosen c join d on d.fold = c.k group by all)""", _LINES + """,
grid as (select row_number() over (order by a.alpha, r.l1_ratio) - 1 as st, a.alpha, r.l1_ratio from
  (select unnest([0.01, 0.1, 1.0]::double[]) as alpha) a, (select unnest([0.6, 0.7, 0.8, 0.9, 0.95, 0.99]::double[]) as l1_ratio) r),
cells as (select k, j from (select unnest(range(1, 6)) as k) a, (select unnest(range(0, 6)) as j) b),
stats as (select k, j, avg(x) as m, stddev_pop(x) as s, avg(y) as ym, covar_pop(x, y) as c
  from cells join d on d.fold <> k and d.inner_fold <> j group by k, j),
fits as (select k, j, st, alpha, l1_ratio, m, s, ym, sign(c / s) * greatest(abs(c / s) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)) as b from stats, grid),
inner_scores as (select f.k, f.j, f.st, avg(pow(d.y - f.ym - f.b * (d.x - f.m) / f.s, 2)) as mse
  from fits f join d on d.fold <> f.k and d.inner_fold = f.j where f.j > 0 group by all),
means as (select k, st, avg(mse) as score from inner_scores group by k, st),
best as (select k, st, score from means qualify row_number() over (partition by k order by round(score, 10), st) = 1),
chosen as (select f.*, best.score from fits f join best using (k, st) where f.j = 0)"""))
def elastic_net_path(spark, sf):
    """Nested search over the whole grid: 5 outer folds, 5 inner ones, 18 sets, one pass of sums."""
    df = _lines(spark, sf).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    run = M.nested_elastic_net(df, "fold", range(1, 6), "id", "y", ["x"], {k: "inner_fold" for k in range(1, 6)}, 5, GRID, "mse")
    mse = evaluate(run.predictions, "True_value", "Predicted_value", ["mse"], ["fold"]).select("fold", F.round("mse", 5).alias("mse"))
    slopes = run.fits.select(F.col("outer").alias("fold"), r6(F.get("slopes", F.lit(0))).alias("slope"))
    best = run.tuning.filter("best").select("fold", "alpha", "l1_ratio", F.round("score", 5).alias("score"))
    return best.join(slopes, "fold").join(mse, "fold").select("fold", "alpha", "l1_ratio", "slope", "score", "mse")


_UNIT_SQL = "((l_orderkey * 10 + l_linenumber) * 2654435761) % 4294967296 / 4294967296.0"


@query("linear_learning_curve", with_views("", """
select size as train_share, round(avg(rmse), 6) as score_mean, round(stddev_pop(rmse), 6) as score_sd, count(*) as folds from
(select f.size, f.k, sqrt(avg(pow(e.y - f.a - f.b * e.x, 2))) as rmse from
 (select k, size, regr_slope(y, x) as b, regr_intercept(y, x) as a from (select unnest(range(1, 6)) as k) o, (select unnest([0.1, 0.325, 0.55, 0.775, 1.0]::double[]) as size) z,
  e where e.fold <> k and e.u < size group by k, size) f
 join e on e.fold = f.k group by f.size, f.k) group by size""", _LINES + f", e as (select *, {_UNIT_SQL} as u from d)"))
def linear_learning_curve(spark, sf):
    """25 fits on growing training sets from sums by fold and size."""
    df = _lines(spark, sf).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    unit = (F.col("id") * F.lit(2654435761)) % F.lit(4294967296) / F.lit(4294967296.0)
    out = M.linear_learning_curve(df, "fold", range(1, 6), "id", "y", ["x"], unit=unit)
    return rounded(out, "score_mean", "score_sd")


@query("external_linear", with_views("", """
select 'sums' as what, cast(count(*) as double) as a, round(sum(p), 3) as b, round(avg(pow(y - p, 2)), 5) as c from s
union all select 'truth ' || cast(y > 25 as int) || ' pred ' || cast(p > 25 as int), cast(count(*) as double), null, null from s group by y > 25, p > 25""",
_LINES + """,
m as (select k, regr_slope(y, x) as b, regr_intercept(y, x) as a from (select unnest(range(1, 6)) as k) o, d where d.fold <> k and l_linenumber < 7 group by k),
s as (select l_orderkey, y, avg(a + b * x) as p from d, m where l_linenumber = 7 group by l_orderkey, y, x, x2, l_returnflag, l_linestatus, fold)"""))
def external_linear(spark, sf):
    """Rows left out of training, scored by the models of all folds in one pass; averages, metrics and confusion counts."""
    df = _lines(spark, sf).withColumn("id", F.xxhash64(*_lines(spark, sf).columns))
    run = L.cross_validate(df.filter("l_linenumber < 7"), "fold", range(1, 6), "id", "y", L.preparation(["x"]), "LinearRegression")
    outside = df.filter("l_linenumber = 7").dropDuplicates(["id"]).select("id", "x", "y")
    rows, scores, counts = L.external_report(outside, run.models, "id", "y", ["mse"], to_class=lambda c: (c > 25).cast("int"))
    total = rows.agg(F.round(F.sum("Predicted_value"), 3).alias("b")).scalar()
    first = scores.select(F.lit("sums").alias("what"), F.col("n").cast("double").alias("a"), total.alias("b"), F.round("mse", 5).alias("c"))
    none = F.lit(None).cast("double")
    name = F.concat(F.lit("truth "), F.col("truth"), F.lit(" pred "), F.col("pred"))
    return first.unionByName(counts.select(name.alias("what"), F.col("n").cast("double").alias("a"), none.alias("b"), none.alias("c")))


_NODES = [
    hierarchy.Node("returned", "returned", "Yes"),
    hierarchy.Node("kind", "l_returnflag", "A", parent="returned", value="YES"),
]


def _tree_sql(n: str) -> str:
    return f"""select fold, count(*) as n, round(sum(r), 3) as returned, round(sum(c), 3) as kind_own, round(sum(c * {n} + 0.5 * (1 - c) * {n}), 3) as kind from s group by fold"""


_TREE = _LINES + """,
r0 as (select k, regr_slope(cast(l_returnflag <> 'N' as int), x) as b, regr_intercept(cast(l_returnflag <> 'N' as int), x) as a
  from (select unnest(range(1, 6)) as k) o, d where d.fold <> k group by k),
c0 as (select k, regr_slope(cast(l_returnflag = 'A' as int), x) as b, regr_intercept(cast(l_returnflag = 'A' as int), x) as a
  from (select unnest(range(1, 6)) as k) o, d where d.fold <> k and l_returnflag <> 'N' group by k),
s as (select d.fold, least(greatest(r0.a + r0.b * x, 0), 1) as r, least(greatest(c0.a + c0.b * x, 0), 1) as c from d join r0 on r0.k = d.fold join c0 on c0.k = d.fold)"""


def _label_tree(spark, sf, hard):
    df = _lines(spark, sf).withColumn("returned", F.when(F.col("l_returnflag") == "N", "No").otherwise("Yes"))
    out = hierarchy.fit_tree(df, _NODES, "fold", range(1, 6), hierarchy.least_squares(["x"]), hard)
    return out.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("returned_own"), 3).alias("returned"), F.round(F.sum("kind_own"), 3).alias("kind_own"),
        F.round(F.sum("kind"), 3).alias("kind"),
    )


@query("label_tree", with_views("", _tree_sql("r"), _TREE))
def label_tree(spark, sf):
    """A child model trained where the parent's label leads to it, its probability carried up the tree."""
    return _label_tree(spark, sf, False)


@query("label_tree_hard", with_views("", _tree_sql("round(r)"), _TREE))
def label_tree_hard(spark, sf):
    """The same with the parent's probability rounded to 0 or 1."""
    return _label_tree(spark, sf, True)


@query("prediction_transformer", with_views("", """
select count(*) as n, round(sum(greatest(a + b * x, 20)), 3) as total from d, (select regr_slope(y, x) as b, regr_intercept(y, x) as a from d where y < 40) m""", _LINES))
def prediction_transformer(spark, sf):
    """Training rows changed before the fit, predictions changed after it."""
    df = _lines(spark, sf)
    estimator = LinearRegression(featuresCol=L.FEATURES, labelCol="y", solver="normal")
    fitted = L.fit_transformed(
        df, L.preparation(["x"]), estimator, fit_transformer=lambda t: t.filter("y < 40"),
        prediction_transformer=lambda p: p.withColumn("prediction", F.greatest("prediction", F.lit(20.0))),
    )
    return fitted.transform(df).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prediction"), 3).alias("total"))


# --- neighbours and forests --------------------------------------------------------

@query("smote_neighbours", """
with d as (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings where label >= 7)
select id, cast(k as int) as k, neighbour, round(distance, 6) as distance from
(select a.vec_id as id, b.vec_id as neighbour, list_distance(a.x, b.x) as distance,
  row_number() over (partition by a.vec_id order by list_distance(a.x, b.x), b.vec_id) as k
 from d a join d b on a.vec_id <> b.vec_id) where k <= 5""")
def smote_neighbours(spark, sf):
    """The five nearest rows of the minority class, exactly, block by block."""
    names = [f"e{i}" for i in range(64)]
    df = load(spark, sf, "embeddings").filter("label >= 7").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    near = minority_neighbours(df, "vec_id", names, 5)
    cells = near.select(F.col("vec_id").alias("id"), F.posexplode("near").alias("at", "n"))
    return cells.select("id", (F.col("at") + 1).alias("k"), F.col("n.neighbour").alias("neighbour"), F.round("n.distance", 6).alias("distance"))


@query("forests_at_once")
def forests_at_once(spark, sf):
    """1000 small forests on demographics, all seeds grown together level by level (bootstrap by hash, so no SQL twin)."""
    subjects = agreement(predictions(spark, sf).filter("Label = 'stress_d' and Model = 'RandomForestRegressor'"), ["snapshot_id", "Model", "Label"])
    merged = subjects.join(demographics(spark, sf), "snapshot_id").withColumn("lang", F.col("lang").cast("double"))
    weights, fit = forests.repeated_forests(merged.select("snapshot_id", "true_mn", "n", "age", "lang"), "snapshot_id", ["n", "age", "lang"], "true_mn", repeats=1000)
    return rounded(weights.withColumn("rho_median", fit.select("median").scalar()), "importance", "rho_median")


# --- blocks and windows of text ------------------------------------------------------

_TURNS = r"""ss as (select conv_id * 1000 + turn as id, unnest(regexp_split_to_array(trim(lower(text)), '[.!?]+(?:\s+|$)|\n+')) as s from conversations),
tk as (select id, unnest(list_filter(regexp_extract_all(s, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}+'))) as word from ss),
f as (select id, word, count(*) as tf from tk group by id, word),
df as (select word, count(*) as df from f group by word),
wt as (select id, word as term, w / sqrt(sum(w * w) over (partition by id)) as weight from
  (select f.id, f.word, f.tf * (ln((1.0 + n) / (1.0 + df.df)) + 1) as w from f join df on f.word = df.word, (select count(*) as n from conversations) where df.df >= 2)),
vc as (select term, row_number() over (order by term) - 1 as idx from (select distinct term from wt))"""


def _turns(spark, sf):
    return load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")


@query("text_step_windows", with_views("", """
select e.id, cast(2 - (e.pos - p.pos) as int) as step, vc.idx as "index", round(wt.weight, 6) as value
from ps e join ps p on e.conv_id = p.conv_id and p.pos between e.pos - 2 and e.pos join wt on wt.id = p.id join vc on vc.term = wt.term""", _TURNS + """,
ps as (select conv_id * 1000 + turn as id, conv_id, row_number() over (partition by conv_id order by turn) as pos from conversations)"""))
def text_step_windows(spark, sf):
    """Sparse text vectors of the last three turns, all on one vocabulary: windows x steps x terms."""
    turns = _turns(spark, sf)
    weights = X.tfidf(turns, "id", "text", min_df=2)
    cells = B.text_cells(weights, "id", B.vocabulary(weights))
    windows = B.text_windows(turns.select("id", "conv_id", "turn"), "id", ["conv_id"], ["turn"], cells, 3)
    return rounded(B.step_rows(windows, "id"), "value")


@query("feature_union", with_views("", """
select id, 'numbers' as block, name, "index", round(value, 6) as value from
(select conv_id * 1000 + turn as id, 'turn' as name, 0 as "index", cast(turn as double) as value from conversations
 union all select conv_id * 1000 + turn, 'length', 1, cast(length(text) as double) from conversations) where value <> 0
union all select wt.id, 'text', wt.term, vc.idx + 2, round(wt.weight, 6) from wt join vc on wt.term = vc.term where wt.weight <> 0
union all select conv_id * 1000 + turn, 'stacked', 'earlier', (select count(*) from vc) + 2, round(1 / (1 + exp(-cast(turn as double))), 6) from conversations""", _TURNS))
def feature_union(spark, sf):
    """Numbers, text weights and a stacked score side by side, each cell with its block's name and its own."""
    turns = _turns(spark, sf).withColumn("length", F.length("text")).withColumn("earlier", S.sigmoid(F.col("turn").cast("double")))
    weights = X.tfidf(turns, "id", "text", min_df=2)
    terms = B.vocabulary(weights)
    rows, names = B.union_blocks(turns, "id", {
        "numbers": (B.dense_cells(turns, "id", ["turn", "length"]), B.named_columns(["turn", "length"], turns)),
        "text": (B.text_cells(weights, "id", terms), terms.select("index", F.col("term").alias("name"))),
        "stacked": (B.dense_cells(turns, "id", ["earlier"]), B.named_columns(["earlier"], turns)),
    })
    cells = rows.select("id", F.inline("cells")).join(names, "index")
    return rounded(cells.select("id", "block", "name", "index", "value"), "value")


@query("sequence_union", """
select conv_id, turn, cast(lag(length(text), 1, 0) over w as double) as a0, cast(lag(turn, 1, 0) over w as double) as a1, cast(length(text) as double) as b0, cast(turn as double) as b1
from conversations window w as (partition by conv_id order by turn)""")
def sequence_union(spark, sf):
    """Two sequences of windows put together along the feature axis."""
    df = load(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    seq = sliding_windows(sliding_windows(df, ["conv_id"], ["turn"], ["n"], 2, "s1"), ["conv_id"], ["turn"], ["turn"], 2, "s2")
    out = B.union_steps(seq, ["s1", "s2"])
    return out.select("conv_id", "turn", *[F.get(F.get("steps", F.lit(i)), F.lit(j)).alias(f"{n}{j}") for i, n in enumerate("ab") for j in range(2)])


# --- shuffles and folds, row by row --------------------------------------------------

@query("train_shuffle_values", with_views("surveys", """
select k.k as test_fold, s.id, case when s.fold = k.k then s.stress_d else x.stress_d end as stress_d
from (select unnest(range(1, 4)) as k) k, s left join x on x.k = k.k and x.id = s.id""", """
s as (select id, stress_d, cast(id % 3 + 1 as int) as fold from surveys),
t as (select k, s.* from (select unnest(range(1, 4)) as k) o, s where s.fold <> k and stress_d is not null),
x as (select a.k, a.id, b.stress_d from (select k, id, row_number() over (partition by k order by id) as pos from t) a
  join (select k, stress_d, row_number() over (partition by k order by (id * 7919) % 10007, id) as pos from t) b using (k, pos))"""))
def train_shuffle_values(spark, sf):
    """Every row's label when the training rows of each fold are shuffled, in an order that SQL can compute."""
    df = surveys(spark, sf).select("id", "stress_d", (F.col("id") % 3 + 1).cast("int").alias("fold"), ((F.col("id") * 7919) % 10007).alias("mix"))
    out = None
    for k in (1, 2, 3):
        part = shuffle_train_labels(df, "id", "stress_d", "fold", k, order=["mix"]).select(F.lit(k).alias("test_fold"), "id", "stress_d")
        out = part if out is None else out.unionByName(part)
    return out


@query("label_folds_dealt", with_views("surveys", """
select label, id, cast(bin as int) as bin, cast((row_number() over (partition by label order by bin, id) - 1) % 5 + 1 as int) as fold from
(select 'stress_d' as label, id, ntile(10) over (order by stress_d, id) - 1 as bin from surveys where stress_d is not null
 union all select 'f1', id, ntile(10) over (order by f1, id) - 1 from surveys where f1 is not null)"""))
def label_folds_dealt(spark, sf):
    """The fold of every row for two labels."""
    return folds_for_labels(surveys(spark, sf), "id", ["stress_d", "f1"], 5, 10, seed=None).select("label", "id", "bin", "fold")


# --- zones by sunrise, then by sunset --------------------------------------------------

def _event_sql(e: str) -> str:
    """Seconds since local midnight of each event time (d_*), and the zip code that most rows with such seconds have (f_*)."""
    mode = "case when max(n) > 0 then arg_min(zipcode, -n * 1000000000 + coalesce(zipcode, 0)) end"
    return f"""
m_{e} as (select {e}, {mode} as zip from (select {e}, zipcode, count(zipcode) as n from s2 where {e} is not null group by 1, 2) group by 1),
o_{e} as (select m.{e}, round((epoch_us(to_timestamp(m.{e}) at time zone k.tz) % 86400000000) / 1e6, 6) as own from m_{e} m left join k on m.zip = k.zipcode),
p_{e} as (select a.{e}, a.own, (select max(b.{e}) from o_{e} b where b.own is not null and b.{e} < a.{e}) as prev_at,
  (select min(b.{e}) from o_{e} b where b.own is not null and b.{e} > a.{e}) as next_at from o_{e} a),
d_{e} as (select p.{e}, coalesce(p.own, q.own) as sec from p_{e} p left join o_{e} q on q.{e} =
  case when next_at is null or p.{e} - prev_at < next_at - p.{e} then prev_at else next_at end),
f_{e} as (select sec, {mode} as zip from (select d.sec, s.zipcode, count(s.zipcode) as n from s2 s join d_{e} d on s.{e} = d.{e} where d.sec is not null group by 1, 2) group by sec)"""


@query("fallback_sunset", with_views("surveys zip_tz", """
select s.id, case when s.zipcode is not null then k.tz else coalesce(k1.tz, k2.tz) end as tz
from s2 s left join k on s.zipcode = k.zipcode
left join d_sunrise d1 on s.sunrise = d1.sunrise left join f_sunrise f1 on f1.sec = d1.sec left join k k1 on k1.zipcode = f1.zip
left join d_sunset d2 on s.sunset = d2.sunset left join f_sunset f2 on f2.sec = d2.sec left join k k2 on k2.zipcode = f2.zip""", """
s2 as (select *, case when id % 13 <> 0 then day_sunrise end as sunrise, day_sunrise + 40000 + (snapshot_id % 3) * 600 as sunset from surveys),
k as (select s.zipcode, z.tz from (select distinct zipcode from surveys where zipcode is not null) s
  join lateral (select tz from zip_tz where zip_tz.zipcode >= s.zipcode order by zip_tz.zipcode limit 1) z on true),""" + ",".join(map(_event_sql, ["sunrise", "sunset"]))))
def fallback_sunset(spark, sf):
    """Zones of rows without a zip code from rows of equal sunrise seconds, else of equal sunset seconds."""
    rows = surveys(spark, sf).select(
        "id", "zipcode", "survey_start_datetime", F.when(F.col("id") % 13 != 0, F.col("day_sunrise")).alias("sunrise"),
        (F.col("day_sunrise") + 40000 + (F.col("snapshot_id") % 3) * 600).alias("sunset"),
    )
    return correct_local_times(rows, zip_zones(spark), sunrise="sunrise", sunset="sunset").select("id", "tz")


# --- metrics by more keys, and whole tables -------------------------------------------

@query("metrics_by_source", with_views("oof", """
select Model, Feature_source, Label, count(*) as n, round(avg(pow(True_value - Predicted_value, 2)), 6) as mse, round(avg(abs(True_value - Predicted_value)), 6) as mae
from (select *, case when id % 2 = 0 then 'RegularFeatureInput' else 'WindowInput' end as Feature_source from oof) group by Model, Feature_source, Label"""))
def metrics_by_source(spark, sf):
    """Metrics of stored predictions by model, feature source and label."""
    rows = oof(spark, sf).withColumn("Feature_source", F.when(F.col("id") % 2 == 0, "RegularFeatureInput").otherwise("WindowInput"))
    return rounded(evaluate(rows, "True_value", "Predicted_value", ["mse", "mae"], ["Model", "Feature_source", "Label"]), "mse", "mae")


_AUC = """c as (select vec_id, label, k, cast(label = k as int) as y, cast(embedding[k + 1] as double) as s from embeddings, (select unnest(range(0, 10)) as k) t),
r as (select *, rank() over (partition by k order by s) + (count(*) over (partition by k, s) - 1) / 2.0 as rk from c),
a as (select k, sum(y) as p, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) as auc from r group by k),
q as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rk from c)"""


@query("auc_by_name", with_views("", """
select (select count(*) from embeddings) as n, round(avg(auc), 6) as roc_auc_ovr,
  round((select (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) from q), 6) as roc_auc_ovr_micro,
  round(sum(auc * p) / sum(p) filter (auc is not null), 6) as roc_auc_ovr_weighted from a""", _AUC))
def auc_by_name(spark, sf):
    """Multi-class AUC by metric name, from an array of class scores."""
    df = load(spark, sf, "embeddings").select("label", F.slice("embedding", 1, 10).alias("scores"))
    names = ["roc_auc_ovr", "roc_auc_ovr_micro", "roc_auc_ovr_weighted"]
    return rounded(evaluate(df, "label", "scores", names), *names)


@query("class_index", """
select event_id, cast(list_position(['view', 'click', 'purchase'], lower(event_type)) - 1 as int) as y,
  (select count(*) from events) as n, (select max(value) from events) as top from events""")
def class_index(spark, sf):
    """Labels by declared class order (unknown ones null), and one-cell tables next to every row."""
    events = load(spark, sf, "events")
    rows = events.select("event_id", S.class_index(F.col("event_type"), ["View", "CLICK", "purchase"]).alias("y"))
    return tagged(rows, {"n": events.agg(F.count(F.lit(1)).alias("n")), "top": events.agg(F.max("value").alias("m"))})


@query("flatten_all", "select vec_id, " + ", ".join(f"embedding[{i + 1}] as embedding_{i}" for i in range(64)) + " from embeddings")
def flatten_all(spark, sf):
    return R.flatten_arrays(load(spark, sf, "embeddings").select("vec_id", "embedding"), {"embedding": 64})


_FOLDED = "s as (select *, cast(snapshot_id % 5 + 1 as int) as fold from surveys)"


def _impute_folds(name: str, strategy: str, value: str) -> None:
    @query(name, with_views("surveys", "select s.id, s.fold, round(coalesce(s.f2, t.v), 6) as f2 from s join t on s.fold = t.k", _FOLDED + f"""
, t as (select k, {value} as v from (select unnest(range(1, 6)) as k) o, s where s.fold <> k group by k)"""))
    def run(spark, sf):
        df = surveys(spark, sf).select("id", (F.col("snapshot_id") % 5 + 1).cast("int").alias("fold"), "f2")
        out = None
        for k in range(1, 6):
            model = P.TrainImputer(inputCols=["f2"], strategy=strategy)
            part = P.fit_transform_rows(model, df, F.col("fold") != k, F.col("fold") == k)
            out = part if out is None else out.unionByName(part)
        return rounded(out, "f2")


_impute_folds("impute_median_folds", "median", "quantile_cont(f2, 0.5)")
_impute_folds("impute_mean_folds", "mean", "avg(f2)")


@query("impute_mode_folds", with_views("surveys", "select s.id, s.fold, round(coalesce(s.f2, t.f2), 6) as f2 from s join t on s.fold = t.k", _FOLDED + """
, t as (select k, f2 from (select k, f2, count(*) as n from (select unnest(range(1, 6)) as k) o, s where s.fold <> k and f2 is not null group by k, f2)
  qualify row_number() over (partition by k order by n desc, f2) = 1)"""))
def impute_mode_folds(spark, sf):
    df = surveys(spark, sf).select("id", (F.col("snapshot_id") % 5 + 1).cast("int").alias("fold"), "f2")
    out = None
    for k in range(1, 6):
        part = P.fit_transform_rows(P.TrainImputer(inputCols=["f2"], strategy="most_frequent"), df, F.col("fold") != k, F.col("fold") == k)
        out = part if out is None else out.unionByName(part)
    return rounded(out, "f2")


@query("binarise_train_median_folds", with_views("surveys", """
select s.id, s.fold, cast(s.f1 > t.m as int) as f1 from s join (select k, quantile_cont(f1, 0.5) as m from (select unnest(range(1, 6)) as k) o, s where s.fold <> k group by k) t
on s.fold = t.k""", _FOLDED))
def binarise_train_median_folds(spark, sf):
    df = surveys(spark, sf).select("id", (F.col("snapshot_id") % 5 + 1).cast("int").alias("fold"), "f1")
    out = None
    for k in range(1, 6):
        part = P.binarise_at_median(df.filter(F.col("fold") == k), ["f1"], fit_on=df.filter(F.col("fold") != k))
        out = part if out is None else out.unionByName(part)
    return out
