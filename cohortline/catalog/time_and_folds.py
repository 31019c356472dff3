"""Local-time correction, permutation baselines and fold assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query, rounded
from cohortline.catalog.tables import folds_wide, load, surveys, with_views, zip_zones
from cohortline.functions.scalar import local_seconds, zip_text
from cohortline.operators import baseline as B
from cohortline.operators import folds as K
from cohortline.operators import lookups as L
from cohortline.operators.rank import group_mode
from cohortline.operators.timezones import correct_local_times, daylight_seconds


def _local(epoch: str, tz: str) -> str:
    return f"(epoch_us(to_timestamp({epoch}) at time zone {tz}) % 86400000000) / 1e6"


_NEXT = """k as (select s.zipcode, z.tz from (select distinct zipcode from surveys where zipcode is not null) s
  join lateral (select tz from zip_tz where zip_tz.zipcode >= s.zipcode order by zip_tz.zipcode limit 1) z on true)"""

_MODE = """m as (select day_sunrise, case when max(n) > 0 then arg_min(zipcode, -n * 1000000000 + coalesce(zipcode, 0)) end as zip from
  (select day_sunrise, zipcode, count(zipcode) as n from surveys group by day_sunrise, zipcode) group by day_sunrise)"""

_OWN = f"""o as (select m.day_sunrise, m.zip, round({_local('m.day_sunrise', 'k.tz')}, 6) as own from m left join k on m.zip = k.zipcode)"""

_NEAR = """p as (select a.day_sunrise, a.own,
   (select max(b.day_sunrise) from o b where b.own is not null and b.day_sunrise < a.day_sunrise) as prev_at,
   (select min(b.day_sunrise) from o b where b.own is not null and b.day_sunrise > a.day_sunrise) as next_at from o a),
d as (select p.day_sunrise, coalesce(p.own, q.own) as day_sunrise_seconds from p left join o q on q.day_sunrise =
   case when next_at is null or p.day_sunrise - prev_at < next_at - p.day_sunrise then prev_at else next_at end)"""


@query("local_seconds", with_views("surveys zip_tz", f"""
select s.id, round({_local('s.survey_start_datetime', 'z.tz')}, 6) as local_s from surveys s join zip_tz z on s.zipcode = z.zipcode"""))
def local_seconds_query(spark, sf):
    df = surveys(spark, sf).join(zip_zones(spark), "zipcode")
    return rounded(df.select("id", local_seconds(F.col("survey_start_datetime"), F.col("tz")).alias("local_s")), "local_s")


@query("group_mode", with_views("surveys", "select day_sunrise, zip from m", _MODE))
def group_mode_query(spark, sf):
    return group_mode(surveys(spark, sf), ["day_sunrise"], "zipcode", "zip").select("day_sunrise", "zip")


@query("next_key_lookup", with_views("surveys zip_tz", """
select s.id, lpad(cast(s.zipcode as varchar), 5, '0') as zip, k.tz from surveys s left join k on s.zipcode = k.zipcode""", _NEXT))
def next_key_lookup(spark, sf):
    found = L.next_key_lookup(surveys(spark, sf).select("id", "zipcode"), "zipcode", zip_zones(spark), "tz")
    return found.select("id", zip_text(F.col("zipcode")).alias("zip"), "tz")


@query("nearest_group", with_views("surveys zip_tz", "select day_sunrise, round(day_sunrise_seconds, 6) as day_sunrise_seconds from d",
       ",\n".join([_NEXT, _MODE, _OWN, _NEAR])))
def nearest_group(spark, sf):
    return rounded(daylight_seconds(surveys(spark, sf), "day_sunrise", "zipcode", zip_zones(spark)), "day_sunrise_seconds")


@query("fallback_lookup", with_views("surveys zip_tz", f"""
select s.id, case when s.zipcode is not null then k.tz else k2.tz end as tz,
  round({_local('s.survey_start_datetime', 'case when s.zipcode is not null then k.tz else k2.tz end')}, 6) as local_s
from surveys s left join k on s.zipcode = k.zipcode left join d on s.day_sunrise = d.day_sunrise
left join f on d.day_sunrise_seconds = f.sec left join k k2 on f.zip = k2.zipcode""",
",\n".join([_NEXT, _MODE, _OWN, _NEAR, """f as (select sec, case when max(n) > 0 then arg_min(zipcode, -n * 1000000000 + coalesce(zipcode, 0)) end as zip from
 (select d.day_sunrise_seconds as sec, s.zipcode, count(s.zipcode) as n from surveys s join d on s.day_sunrise = d.day_sunrise
  where d.day_sunrise_seconds is not null group by 1, 2) group by sec)"""])))
def fallback_lookup(spark, sf):
    out = correct_local_times(surveys(spark, sf).select("id", "zipcode", "survey_start_datetime", "day_sunrise"), zip_zones(spark))
    return rounded(out.select("id", "tz", F.col("survey_start_datetime_seconds").alias("local_s")), "local_s")


@query("adjacent_groups", with_views("surveys", """
select day_sunrise, lag(day_sunrise) over (order by day_sunrise) as prev, lead(day_sunrise) over (order by day_sunrise) as next
from (select distinct day_sunrise from surveys)"""))
def adjacent_groups(spark, sf):
    return L.neighbours(surveys(spark, sf).select("day_sunrise").distinct(), "day_sunrise")


# The engines' hash functions differ, so the SQL twins use an arithmetic order both can compute.
_MIX = "(id * 7919) % 10007"


def _mixed(df):
    return df.withColumn("mix", (F.col("id") * 7919) % 10007)


def _shuffle_sql(keys: str) -> str:
    by = f"partition by {keys} " if keys else ""
    on = f"a.pos = b.pos and a.{keys} = b.{keys}" if keys else "a.pos = b.pos"
    return f"""
select s.id, s.stress_d, x.mixed from surveys s left join (select a.id, b.stress_d as mixed from
 (select id, snapshot_id, row_number() over ({by}order by id) as pos from surveys where stress_d is not null) a join
 (select id, snapshot_id, stress_d, row_number() over ({by}order by {_MIX}, id) as pos from surveys where stress_d is not null) b
 on {on}) x on s.id = x.id"""


@query("label_shuffle", with_views("surveys", _shuffle_sql("")))
def label_shuffle(spark, sf):
    df = _mixed(surveys(spark, sf))
    return B.shuffle_label(df, "id", "stress_d", "mixed", order=["mix"]).select("id", "stress_d", "mixed")


@query("label_shuffle_within", with_views("surveys", _shuffle_sql("snapshot_id")))
def label_shuffle_within(spark, sf):
    df = _mixed(surveys(spark, sf))
    return B.shuffle_label(df, "id", "stress_d", "mixed", within=["snapshot_id"], order=["mix"]).select("id", "stress_d", "mixed")


@query("seeded_baselines", with_views("surveys", """
select snapshot_id, stress_d as label, count(*) as n, count(*) as n_within from surveys where stress_d is not null group by 1, 2"""))
def seeded_baselines(spark, sf):
    """A within-subject shuffle keeps each subject's multiset of labels."""
    df = B.with_baselines(surveys(spark, sf).select("id", "snapshot_id", "stress_d"), "id", "stress_d", "snapshot_id")
    before = df.filter("stress_d is not null").groupBy("snapshot_id", F.col("stress_d").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    after = df.filter("stress_d_shuffledWithinSubject is not null").groupBy(
        "snapshot_id", F.col("stress_d_shuffledWithinSubject").alias("label")
    ).agg(F.count(F.lit(1)).alias("n_within"))
    return before.join(after, ["snapshot_id", "label"], "full_outer")


@query("train_shuffle", with_views("surveys", """
select cast(id % 3 + 1 as int) as fold, count(stress_d) as n, sum(stress_d) as total from surveys group by 1"""))
def train_shuffle(spark, sf):
    """Train labels are permuted among train rows; test rows keep theirs. Each fold is shuffled for and checked."""
    df = surveys(spark, sf).select("id", "stress_d", (F.col("id") % 3 + 1).cast("int").alias("fold"))
    own = df.groupBy("fold").agg(F.count("stress_d").alias("n"), F.sum("stress_d").alias("total"))
    out = None
    for k in (1, 2, 3):
        sums = lambda d: d.agg(F.sum(F.when(F.col("fold") == k, F.col("stress_d"))), F.sum(F.when(F.col("fold") != k, F.col("stress_d")))).first()  # noqa: E731, B023
        same = tuple(sums(df)) == tuple(sums(B.shuffle_train_labels(df, "id", "stress_d", "fold", k)))
        part = own.filter(F.col("fold") == k).withColumn("total", F.when(F.lit(same), F.col("total")))
        out = part if out is None else out.unionByName(part)
    return out


@query("kfold", """select o_orderkey as id, cast(ntile(5) over (order by o_orderkey) as int) as fold from orders""")
def kfold(spark, sf):
    return K.k_folds(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", 5)


@query("kfold_random", """select o_orderkey as id, cast(ntile(5) over (order by (o_orderkey * 7919) % 10007, o_orderkey) as int) as fold from orders""")
def kfold_random(spark, sf):
    df = _mixed(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))
    return K.k_folds(df, "id", 5, order=["mix"])


_BIN = "select id, cast(ntile(10) over (order by f1, id) - 1 as int) as bin from surveys"


@query("strat_bins", with_views("surveys", f"""
select id, bin, cast((row_number() over (order by bin, id) - 1) % 5 + 1 as int) as fold from ({_BIN})"""))
def strat_bins(spark, sf):
    return K.stratified_folds(surveys(spark, sf), "id", "f1", 5, bins=10)


@query("strat_edges", with_views("surveys", """
select id, bin, cast((row_number() over (order by bin, id) - 1) % 5 + 1 as int) as fold from
(select id, case when stress_d >= 4 then 2 when stress_d >= 2 then 1 else 0 end as bin from surveys where stress_d is not null)"""))
def strat_edges(spark, sf):
    return K.stratified_folds(surveys(spark, sf), "id", "stress_d", 5, edges=[2.0, 4.0])


_GROUP_FOLD = """select snapshot_id, n, cast(case when (pos // 5) % 2 = 0 then pos % 5 else 4 - pos % 5 end + 1 as int) as fold from
(select snapshot_id, n, row_number() over (order by n desc, snapshot_id) - 1 as pos from
 (select snapshot_id, count(*) as n from surveys group by snapshot_id))"""


@query("group_fold", with_views("surveys", _GROUP_FOLD))
def group_fold(spark, sf):
    return K.group_folds(surveys(spark, sf), "snapshot_id", 5)


@query("strat_group_fold", with_views("surveys", """
select snapshot_id, bin, cast((row_number() over (order by bin, snapshot_id) - 1) % 5 + 1 as int) as fold from
(select snapshot_id, cast(ntile(10) over (order by m, snapshot_id) - 1 as int) as bin from
 (select snapshot_id, avg(stress_d) as m from surveys group by snapshot_id) where m is not null)"""))
def strat_group_fold(spark, sf):
    return K.stratified_group_folds(surveys(spark, sf), "snapshot_id", "stress_d", 5, bins=10)


@query("premade_folds", with_views("folds_wide", " union all ".join(
    f"select cast(Fold{i}_{s} as bigint) as row_id, {i} as fold, '{s}' as split, pos as position from folds_wide where Fold{i}_{s} is not null"
    for i in (1, 2) for s in ("train", "test"))))
def premade_folds(spark, sf):
    return K.folds_from_wide(folds_wide(spark, sf), 2)


@query("wide_folds", with_views("surveys", "select " + ", ".join(
    ["pos"] + [f"max(case when c = 'Fold{i}_{s}' then id end) as Fold{i}_{s}" for s in ("train", "test") for i in (1, 2)]
) + """ from (select id, c, row_number() over (partition by c order by id) - 1 as pos from
 (select id, 'Fold' || k || case when cast(id % 2 + 1 as int) = k then '_test' else '_train' end as c from surveys, (values (1), (2)) v(k))) group by pos"""))
def wide_folds(spark, sf):
    folds = surveys(spark, sf).select("id", (F.col("id") % 2 + 1).cast("int").alias("fold"))
    return K.folds_to_wide(folds, "id", 2)


@query("key_folds", with_views("surveys", f"select snapshot_id, fold as test_fold from ({_GROUP_FOLD})"))
def key_folds(spark, sf):
    df = surveys(spark, sf)
    return K.key_folds(df, "snapshot_id", K.group_folds(df, "snapshot_id", 5))


@query("fold_membership", with_views("surveys", f"""
select g.fold, count(*) as n_test, count(distinct s.snapshot_id) as subjects from surveys s join ({_GROUP_FOLD}) g on s.snapshot_id = g.snapshot_id group by g.fold"""))
def fold_membership(spark, sf):
    df = surveys(spark, sf).select("id", "snapshot_id")
    joined = K.with_fold(df, K.group_folds(df, "snapshot_id", 5), "snapshot_id")
    return joined.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.count_distinct("snapshot_id").alias("subjects"))


@query("manual_split", with_views("surveys", """
select split, count(*) as n from (select case when survey_date >= date '2024-01-15' then 'test' else 'train' end as split from surveys) group by split"""))
def manual_split(spark, sf):
    df = K.manual_split(surveys(spark, sf), F.col("survey_date") >= F.lit("2024-01-15").cast("date"))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("label_folds", with_views("surveys", """
select label, bin, count(*) as n from (select 'stress_d' as label, ntile(10) over (order by stress_d, id) - 1 as bin from surveys where stress_d is not null
 union all select 'f1', ntile(10) over (order by f1, id) - 1 from surveys) group by label, bin"""))
def label_folds(spark, sf):
    """Folds for two labels; the SQL twin counts rows per bin."""
    folds = K.folds_for_labels(surveys(spark, sf), "id", ["stress_d", "f1"], 5, 10, seed=3748)
    return folds.groupBy("label", F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
