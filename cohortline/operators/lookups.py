"""Ordered lookups on group tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators.rank import attach
from cohortline.operators.running import running


def next_key_lookup(df: DataFrame, key: str, table: DataFrame, value: str, mode: str = "next") -> DataFrame:
    """Exact lookup; a key the table lacks takes the next greater known key.

    ``mode='nearest'`` takes the closest known key instead (ties: the greater).
    Only distinct keys are ordered. NULL keys and keys without a neighbour give NULL.
    """
    known = table.select(F.col(key), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("__hit"))
    asked = df.select(key).filter(F.col(key).isNotNull()).distinct()
    slots = asked.join(known, key, "full_outer").groupBy(key).agg(F.min("__hit").alias("__hit"))
    measures = {"__next": ("min", F.col("__hit"), "after")}
    if mode == "nearest":
        measures["__prev"] = ("max", F.col("__hit"))
    ahead = running(slots, [], [key], measures)
    if mode == "nearest":
        closer = (F.col(key) - F.col("__prev.k")) < (F.col("__next.k") - F.col(key))
        fallback = F.when(F.col("__next").isNull() | closer, F.col("__prev.v")).otherwise(F.col("__next.v"))
    else:
        fallback = F.col("__next.v")
    resolved = ahead.select(key, F.coalesce(F.col("__hit.v"), fallback).alias(value))
    return attach(df, resolved, [key], "left")


def nearest_populated(df: DataFrame, axis: str, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Fill groups without a value from the nearest group (along ``axis``) that has one.

    ``df`` has one row per group. Ties go to the later group; edge groups use
    their only populated neighbour.
    """
    mine = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).alias("k"), F.col(value).alias("v")))
    both = df.withColumn("__own", mine)
    both = running(both, keys, [axis], {"__prev": ("max", F.col("__own")), "__next": ("min", F.col("__own"), "after")})
    before, after = F.col(axis) - F.col("__prev.k"), F.col("__next.k") - F.col(axis)
    picked = F.when(F.col("__next").isNull() | (before < after), F.col("__prev.v")).otherwise(F.col("__next.v"))
    return both.withColumn(name, F.coalesce(F.col(value), picked)).drop("__own", "__prev", "__next")


def neighbours(df: DataFrame, axis: str, keys: Sequence[str] = ()) -> DataFrame:
    """Previous and next group on an ordered axis (one row per group)."""
    return running(df, keys, [axis], {"prev": ("max", F.col(axis)), "next": ("min", F.col(axis), "after")})
