"""Running aggregates, ranks and quantiles: edge cases and brute force, in both forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.operators.rank import average_rank, exact_quantiles, group_mode, pearson_expr, spearman
from cohortline.operators.running import ntile_of, row_positions, running, with_slices


def skewed(spark, n=3000):
    """One group holds most rows, many ties, some nulls."""
    rng = np.random.default_rng(5)
    g = np.where(rng.random(n) < 0.7, "hot", np.char.add("g", rng.integers(0, 20, n).astype(str)))
    x = np.round(rng.normal(size=n), 2)
    y = rng.integers(1, 6, n).astype(float)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "x": x, "y": y})
    pdf.loc[pdf.index % 17 == 0, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df


def test_ranks_of_ties_and_nulls(spark, both_forms):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 3.0), (4, None), (5, 5.0)], "id int, v double")
    got = {r["id"]: r["rank_avg"] for r in average_rank(df, [], "v").collect()}
    assert got == {1: 3.5, 2: 1.5, 3: 1.5, 4: None, 5: 3.5}


def test_ranks_match_pandas(spark, both_forms):
    pdf, df = skewed(spark)
    want = pdf.groupby("g")["x"].rank()
    got = average_rank(df, ["g"], "x").toPandas().set_index("id")["rank_avg"]
    pd.testing.assert_series_equal(got.sort_index().astype(float), want, check_names=False)


def test_slices_cut_the_hot_group(spark):
    spark.conf.set("spark.cohortline.slices.rows", "7")
    _, df = skewed(spark)
    sizes = with_slices(df.select("g", "id"), ["g"], ["id"]).groupBy("g", "__slice").count()
    hot = sizes.filter("g = 'hot'").agg(F.max("count"), F.count("*")).first()
    assert hot[1] > 50 and hot[0] < 200
    spark.conf.unset("spark.cohortline.slices.rows")


def test_small_groups_above_the_target_are_cut(spark):
    """A group of under one percent of the rows is cut as soon as it holds several slices' rows."""
    spark.conf.set("spark.cohortline.slices.rows", "100")
    df = spark.range(200_000).selectExpr("if(id < 1500, 'some', concat('g', id % 5000)) as g", "id")
    sizes = with_slices(df, ["g"], ["id"]).filter("g = 'some'").groupBy("__slice").count()
    assert sizes.count() > 5 and sizes.agg(F.max("count")).first()[0] < 1500
    spark.conf.unset("spark.cohortline.slices.rows")


def test_running_sum_max_min(spark, both_forms):
    pdf, df = skewed(spark)
    out = running(df.select("g", "id", "y"), ["g"], ["id"], {
        "s": ("sum", F.col("y")), "m": ("max", F.col("y")), "later": ("min", F.col("y"), "after"),
    }).toPandas().sort_values(["g", "id"]).reset_index(drop=True)
    ref = pdf.sort_values(["g", "id"])
    by = ref.groupby("g")["y"]
    assert np.allclose(out["s"], (by.cumsum() - ref["y"]).to_numpy())
    assert np.allclose(out["m"].astype(float), by.transform(lambda s: s.shift().cummax()).to_numpy(), equal_nan=True)
    back = ref[::-1].groupby("g")["y"].transform(lambda s: s.shift().cummin())[::-1]
    assert np.allclose(out["later"].astype(float), back.to_numpy(), equal_nan=True)


def test_positions_are_dense(spark, both_forms):
    _, df = skewed(spark)
    for keys in ([], ["g"]):
        got = row_positions(df, keys, ["x", "id"], descending=True).groupBy(*keys).agg(
            F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_distinct("pos").alias("d"), F.count("*").alias("n"))
        assert got.filter("lo <> 0 or hi <> n - 1 or d <> n").count() == 0


def test_quantiles_and_mode(spark, both_forms):
    pdf, df = skewed(spark)
    got = exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.9], ["a", "b", "c"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].quantile([0.25, 0.5, 0.9]).unstack()
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy())
    mode = group_mode(df, ["g"], "x").toPandas().set_index("g")["mode"].sort_index()
    assert np.allclose(mode, pdf.groupby("g")["x"].agg(lambda s: s.mode()[0]).sort_index())


def test_mode_tie_and_all_null(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", 3), ("a", 5), ("b", None), ("b", None)], "g string, v int")
    assert {r["g"]: r["mode"] for r in group_mode(df, ["g"], "v").collect()} == {"a": 3, "b": None}


def test_spearman_matches_pandas(spark, both_forms):
    pdf, df = skewed(spark)
    got = spearman(df, ["g"], "x", "y").toPandas().set_index("g")["rho"].sort_index()
    want = {}
    for g, part in pdf.dropna().groupby("g"):
        want[g] = part["x"].rank().corr(part["y"].rank())
    assert np.allclose(got, pd.Series(want).sort_index())


def test_spearman_constant_and_single_row(spark, both_forms):
    df = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 2.0), ("s", 1.0, 1.0)], "g string, x double, y double")
    assert [r["rho"] for r in spearman(df, ["g"], "x", "y").collect()] == [None, None]


@pytest.mark.parametrize("n,k", [(10, 3), (5, 5), (3, 5), (101, 10)])
def test_ntile(spark, n, k):
    df = spark.range(n)
    got = [r[0] for r in df.select(ntile_of(F.col("id"), F.lit(n), k)).collect()]
    want = [r[0] - 1 for r in spark.sql(f"select ntile({k}) over (order by id) from range({n})").collect()]
    assert got == want


def test_spearman_constant_over_many_partitions(spark, both_forms):
    df = spark.range(0, 29996, 1, 7).select((F.col("id") * 0 + 4).cast("double").alias("x"), (F.col("id") % 1013).cast("double").alias("y"))
    assert spearman(df, [], "x", "y").first()["rho"] is None
    assert df.agg(pearson_expr(F.col("x") + 0.1, F.col("y"))).first()[0] is None
