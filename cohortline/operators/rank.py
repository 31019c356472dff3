"""Average-tie ranks, exact quantiles and rank correlation on value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.running import running, settle, slice_rows


def null_safe(left: str, right: str, columns: Sequence[str]) -> Column:
    """``left.c <=> right.c`` over all columns, for aliased frames."""
    on = None
    for c in columns:
        same = F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        on = same if on is None else on & same
    return on


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", bounded: bool = False) -> DataFrame:
    """Join ``table`` (one row per key) to ``df``; nulls in keys match each other.

    Left as an ordinary join on purpose: adaptive execution broadcasts the
    table when its measured size is small and splits hot keys when it is not.
    ``bounded`` is for tables whose row count is fixed by an argument, such as
    one row per fold; they are broadcast, so ``df`` is never shuffled on a
    handful of keys.
    """
    if bounded:
        table = F.broadcast(table)
    if not keys:
        one = table.select(F.struct(*table.columns).alias("__one")).scalar()  # one subquery for all columns
        return df.withColumn("__one", one).select("*", *[F.col("__one").getField(c).alias(c) for c in table.columns]).drop("__one")
    extra = [c for c in table.columns if c not in keys]
    joined = df.alias("a").join(table.alias("b"), null_safe("a", "b", keys), how)
    return joined.select("a.*", *[F.col(f"b.{c}") for c in extra])


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (group, value) with its multiplicity ``n``; nulls dropped."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))


def tie_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Rank table per (group, value): ``n``, ``below`` and the average rank ``rank_avg``.

    Ties are collapsed on the map side before anything is ordered, so a value
    shared by a third of all rows is one row here.
    """
    df = settle(df)
    counts = value_counts(df, keys, value, weight)
    ranked = running(
        counts,
        keys,
        [value],
        {"below": ("sum", F.col("n"))},
        source=df.filter(F.col(value).isNotNull()).select(*keys, value),
    )
    return ranked.withColumn("rank_avg", F.col("below") + (F.col("n") + 1) / F.lit(2.0))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank_avg") -> DataFrame:
    """Add the average-tie rank of ``value`` in its group; NULL stays NULL."""
    df = settle(df)
    table = tie_ranks(df, keys, value).select(*keys, value, F.col("rank_avg").alias(name))
    return attach(df, table, [*keys, value], "left")


def varies(x: Column) -> Column:
    """True where a group holds two different values.

    Merged partial variances of a constant can differ from 0 by rounding, so
    constancy is decided by minimum and maximum.
    """
    return F.min(x) < F.max(x)


def pearson_expr(x: Column, y: Column) -> Column:
    """Pearson r as one aggregate; NULL on constant or single-row groups."""
    ratio = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(varies(x) & varies(y), ratio)


def _pair(value: str) -> Column:
    return F.col(value).cast("double")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Spearman rho per group on pairwise complete rows.

    Rows collapse to distinct (x, y) pairs first, weighted by their number. Groups
    of few pairs are ranked by windows over the group, all on one partitioning; the
    groups that a sample finds large get rank tables by slices.
    """
    complete = df.select(*keys, _pair(x).alias("__x"), _pair(y).alias("__y")).dropna(subset=["__x", "__y"])
    complete = settle(complete)
    if not keys:
        return _rho(_ranked_by_tables(complete, keys), keys, name)
    large = _large_groups(complete, keys)
    if large is None:
        return _rho(_ranked_in_group(complete, keys), keys, name)
    on = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    few, many = (complete.alias("a").join(F.broadcast(large).alias("b"), on, how) for how in ("left_anti", "left_semi"))
    return _rho(_ranked_in_group(few, keys), keys, name).unionByName(_rho(_ranked_by_tables(many, keys), keys, name))


#: Sampled pairs from which on a group is large; one pair in ``rows of a slice`` is sampled, by its hash.
LARGE_SAMPLES = 10


def _large_groups(complete: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Groups of more than about LARGE_SAMPLES slices of distinct pairs, if any; there are fewer than pairs / that number."""
    spark = complete.sparkSession
    unit = F.xxhash64(*keys, "__x", "__y") / F.lit(float(2**64)) + F.lit(0.5)
    sampled = complete.filter(unit < 1.0 / slice_rows(spark)).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    found = sampled.filter(F.col("__n") >= LARGE_SAMPLES).select(*keys)
    rows = found.collect()
    return spark.createDataFrame(rows, found.schema) if rows else None


def _ranked_in_group(complete: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct pairs with both average-tie ranks, from windows that hold a group's pairs."""
    pairs = complete.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("w"))

    def rank(c: str) -> Column:
        upto = F.sum("w").over(Window.partitionBy(*keys).orderBy(c))  # with all ties of the row
        return upto - (F.sum("w").over(Window.partitionBy(*keys, c)) - 1) / F.lit(2.0)

    return pairs.withColumn("rx", rank("__x")).withColumn("ry", rank("__y"))


def _ranked_by_tables(complete: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for groups of any size: both rank tables come from value counts."""
    pairs = complete.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("w"))
    rx = tie_ranks(complete, keys, "__x").select(*keys, "__x", F.col("rank_avg").alias("rx"))
    ry = tie_ranks(complete, keys, "__y").select(*keys, "__y", F.col("rank_avg").alias("ry"))
    return attach(attach(pairs, rx, [*keys, "__x"]), ry, [*keys, "__y"])


def _rho(ranked: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    n, sx, sy = F.sum(w), F.sum(w * a), F.sum(w * b)
    cov = F.sum(w * a * b) - sx * sy / n
    vx, vy = F.sum(w * a * a) - sx * sx / n, F.sum(w * b * b) - sy * sy / n
    rho = F.when(varies(a) & varies(b), F.try_divide(cov, F.sqrt(vx * vy)))
    return ranked.groupBy(*keys).agg(n.alias("n_pairs"), rho.alias(name))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact interpolated quantiles per group (position ``(n-1)p``), nulls ignored.

    ``percentile`` keeps every distinct value of a group in one task; this form
    reads the two neighbouring order statistics off the running counts.
    """
    df = df.select(*keys, value)
    df = settle(df)
    ranked = tie_ranks(df, keys, value).select(*keys, value, "n", "below")
    sizes = value_counts_total(df, keys, value)
    sized = attach(ranked, sizes, keys)
    aggs = []
    for p, name in zip(probs, names):
        at = (F.col("__total") - 1) * F.lit(float(p))
        low, frac = F.floor(at), at - F.floor(at)
        holds = lambda idx: (F.col("below") <= idx) & (idx < F.col("below") + F.col("n"))
        lo = F.max(F.when(holds(low), F.col(value)))
        hi = F.max(F.when(holds(F.ceil(at)), F.col(value)))
        aggs.append((lo + (hi - lo) * F.max(frac)).alias(name))
    return sized.groupBy(*keys).agg(*aggs)


def value_counts_total(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group, nulls ignored."""
    return exact_quantiles(df.withColumn(value, F.col(value).cast("double")), keys, value, [0.5], [name])


def group_mode(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group, smallest on ties, NULL for an all-null group.

    Two counting steps instead of ``mode()``, whose buffer holds every distinct
    value of the group.
    """
    counted = df.groupBy(*keys, value).agg(F.count(value).alias("n"))
    best = F.min_by(F.col(value), F.struct((-F.col("n")).alias("r"), F.col(value).alias("v")))
    present = F.max(F.col("n"))
    return counted.groupBy(*keys).agg(F.when(present > 0, best).alias(name), present.alias(f"{name}_n"))
