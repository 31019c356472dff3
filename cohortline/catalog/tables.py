"""Study-shaped views over the given tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = [
    (10000, "America/New_York"),
    (11000, "America/Chicago"),
    (12000, "America/Denver"),
    (14000, "America/Los_Angeles"),
    (16000, "America/Phoenix"),
]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    model = (
        F.when(F.col("l_returnflag") == "A", "ElasticNet")
        .when(F.col("l_returnflag") == "N", "RandomForestRegressor")
        .otherwise("MLP")
    )
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_suppkey").alias("snapshot_id"),
        model.alias("Model"),
        F.when(F.col("l_linestatus") == "F", "stress_d").otherwise("stress_d_shuffled").alias("Label"),
        F.col("l_quantity").alias("True_value"),
        (F.col("l_extendedprice") / 2000).alias("Predicted_value"),
        F.to_date("l_shipdate").alias("survey_date"),
    )


def oof(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    crossed = orders.withColumn(
        "Model", F.explode(F.array(F.lit("ElasticNet"), F.lit("RandomForestRegressor")))
    ).withColumn("Label", F.explode(F.array(F.lit("stress_d"), F.lit("stress_d_shuffled"))))
    key = F.when(F.col("Label") == "stress_d", F.col("o_custkey")).otherwise(F.col("o_orderkey"))
    return crossed.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 100).alias("snapshot_id"),
        "Model",
        "Label",
        (key % 5 + 1).cast("double").alias("True_value"),
        F.when(F.col("Model") == "ElasticNet", F.col("o_totalprice") / 150000 + 1)
        .otherwise((F.col("o_custkey") % 7).cast("double") / 2 + 1)
        .alias("Predicted_value"),
    )


def surveys(spark: SparkSession, sf: str) -> DataFrame:
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")
    no_zip = (eid % 10 == 0) | (uid % 50).isin(0, 10, 20)
    return load(spark, sf, "events").select(
        eid.alias("id"),
        uid.alias("snapshot_id"),
        F.to_date("ts").alias("survey_date"),
        epoch.alias("survey_start_datetime"),
        F.when(~no_zip, (uid % 7) * 1000 + 10000).alias("zipcode"),
        (F.floor(epoch / 86400) * 86400 + 25200 + (uid % 50) * 60).alias("day_sunrise"),
        F.when(F.col("event_type") != "error", (F.floor(v) % 5 + 1).cast("double")).alias("stress_d"),
        v.alias("f1"),
        F.when(eid % 7 != 0, v * v).alias("f2"),
        F.col("event_type").alias("f3"),
    )


def zip_zones(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({z}L, '{t}')" for z, t in ZONES)
    return spark.sql(f"select * from values {rows} as t(zipcode, tz)")


def daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    return (
        load(spark, sf, "events")
        .filter(F.col("event_type").isin("click", "view"))
        .groupBy(F.col("user_id").alias("snapshot_id"), F.to_date("ts").alias("survey_date"))
        .agg(F.avg("value").alias("avg_stress"))
    )


def demographics(spark: SparkSession, sf: str) -> DataFrame:
    return (
        load(spark, sf, "customer")
        .groupBy((F.col("c_custkey") % 100).alias("snapshot_id"))
        .agg(F.min("c_nationkey").alias("lang"), F.min("c_mktsegment").alias("cohort"), F.avg("c_acctbal").alias("age"))
    )


def binary_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(load(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("snapshot_id"),
        F.col("quality").alias("truth"),
        F.col("toxic").alias("truth2"),
        (F.col("n_chars").cast("double") / 20000).alias("score"),
    )


def multiclass(spark: SparkSession, sf: str) -> DataFrame:
    shift = F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("truth"),
        ((F.col("label") + shift) % 10).cast("int").alias("pred"),
    )


def folds_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A premade two-fold file: even rows train fold 1, odd rows train fold 2, the smaller half is tested."""
    r = F.col("c_custkey")
    half = load(spark, sf, "customer").agg(F.floor(F.count(F.lit(1)) / 2).alias("h")).scalar()
    return load(spark, sf, "customer").select(
        r.alias("pos"),
        (r * 2).alias("Fold1_train"),
        F.when(r < half, r * 2 + 1).alias("Fold1_test"),
        (r * 2 + 1).alias("Fold2_train"),
        F.when(r < half, r * 2).alias("Fold2_test"),
    )


_EPOCH = "(epoch_us(ts) / 1e6)"

VIEWS = {
    "predictions": """select l_orderkey as id, l_suppkey as snapshot_id,
  case l_returnflag when 'A' then 'ElasticNet' when 'N' then 'RandomForestRegressor' else 'MLP' end as Model,
  case l_linestatus when 'F' then 'stress_d' else 'stress_d_shuffled' end as Label,
  l_quantity as True_value, l_extendedprice / 2000 as Predicted_value,
  cast(l_shipdate as date) as survey_date
from lineitem""",
    "oof": """select o_orderkey as id, o_custkey % 100 as snapshot_id, m.Model, l.Label,
  case when l.Label = 'stress_d' then cast(1 + o_custkey % 5 as double) else cast(1 + o_orderkey % 5 as double) end as True_value,
  case when m.Model = 'ElasticNet' then 1 + o_totalprice / 150000 else 1 + cast(o_custkey % 7 as double) / 2 end as Predicted_value
from orders
  cross join (select * from (values ('ElasticNet'), ('RandomForestRegressor')) as t(Model)) m
  cross join (select * from (values ('stress_d'), ('stress_d_shuffled')) as t(Label)) l""",
    "surveys": f"""select event_id as id, user_id as snapshot_id, cast(ts as date) as survey_date,
  {_EPOCH} as survey_start_datetime,
  case when event_id % 10 = 0 or user_id % 50 in (0, 10, 20) then null else 10000 + (user_id % 7) * 1000 end as zipcode,
  cast(floor({_EPOCH} / 86400) as bigint) * 86400 + 25200 + (user_id % 50) * 60 as day_sunrise,
  case when event_type = 'error' then null else cast(1 + cast(floor(value) as bigint) % 5 as double) end as stress_d,
  value as f1, case when event_id % 7 = 0 then null else value * value end as f2, event_type as f3
from events""",
    "zip_tz": "select * from (values " + ", ".join(f"(cast({z} as bigint), '{t}')" for z, t in ZONES) + ") as t(zipcode, tz)",
    "daily_summary": """select user_id as snapshot_id, cast(ts as date) as survey_date, avg(value) as avg_stress
from events where event_type in ('click', 'view') group by user_id, cast(ts as date)""",
    "demographics": """select c_custkey % 100 as snapshot_id, min(c_nationkey) as lang, min(c_mktsegment) as cohort, avg(c_acctbal) as age
from customer group by c_custkey % 100""",
    "binary_scores": """select d.doc_id as id, d.lang as snapshot_id, l.quality as truth, l.toxic as truth2,
  cast(d.n_chars as double) / 20000 as score from documents d join labels l on d.doc_id = l.doc_id""",
    "multiclass": """select vec_id as id, label as truth, cast((label + case when vec_id % 3 = 0 then 1 else 0 end) % 10 as int) as pred
from embeddings""",
    "folds_wide": """select r as pos, r * 2 as Fold1_train, case when r < h then r * 2 + 1 end as Fold1_test,
  r * 2 + 1 as Fold2_train, case when r < h then r * 2 end as Fold2_test
from (select c_custkey as r, (select count(*) // 2 from customer) as h from customer) t""",
}


def with_views(names: str, body: str, more: str = "") -> str:
    """SQL with the named views (and further CTEs ``more``) in front of ``body``."""
    parts = [f"{n} as ({VIEWS[n]})" for n in names.split()]
    if more:
        parts.append(more.strip())
    return "with " + ",\n".join(parts) + "\n" + body if parts else body


def sql_ranks(source: str, keys: str, columns: dict[str, str]) -> str:
    """Average-tie ranks of several columns as a select list."""
    by = f"{keys}, " if keys else ""
    part = f"partition by {keys} " if keys else ""
    cells = [
        f"rank() over ({part}order by {c}) + (count(*) over (partition by {by}{c}) - 1) / 2.0 as {a}"
        for a, c in columns.items()
    ]
    return f"select *, {', '.join(cells)} from {source}"


def sql_corr(a: str, b: str) -> str:
    return (
        f"case when stddev_pop({a}) = 0 or stddev_pop({b}) = 0 then null "
        f"else covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) end"
    )


SMAPE_SQL = (
    "avg(coalesce(2 * abs(True_value - Predicted_value) / nullif(abs(True_value) + abs(Predicted_value), 0), 0))"
)

# Subject agreement as CTEs ``r`` (ranks) and ``g`` (one row per subject, model and label).
GROUPS_SQL = f"""
r as ({sql_ranks('predictions', 'snapshot_id, Model, Label', {'rt': 'True_value', 'rp': 'Predicted_value'})}),
g as (select snapshot_id, Model, Label, count(*) as n, avg(True_value) as true_mn, avg(Predicted_value) as pred_mn,
  stddev_samp(True_value) as true_sd, stddev_samp(Predicted_value) as pred_sd,
  {SMAPE_SQL} as smape,
  avg(abs((True_value - Predicted_value) / nullif(True_value, 0))) as mape,
  count(distinct True_value) as n_classes,
  {sql_corr('rt', 'rp')} as rho
  from r group by snapshot_id, Model, Label)
"""


def sql_t_p(t: str, dof: str) -> str:
    """Two-sided p of Student's t for a whole number of degrees of freedom, by its finite series in the angle atan(t / sqrt(dof))."""
    angle = f"atan(abs({t}) / sqrt({dof}))"
    odd = f"list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos({angle}), 2 * k + 1)))"
    even = f"list_sum(list_transform(range(0, {dof} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos({angle}), 2 * k)))"
    return f"(1 - case when {dof} % 2 = 1 then 2 / pi() * ({angle} + sin({angle}) * coalesce({odd}, 0)) else sin({angle}) * {even} end)"
