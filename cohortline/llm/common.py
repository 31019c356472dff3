"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of text handed to a Python worker at once; bounds its memory when texts are long.
TEXTS_PER_BATCH = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of at most TEXTS_PER_BATCH rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))


def settle(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the cluster's shared folder (spark.checkpoint.dir).

    Where the setting is absent a temporary folder is used, but only by a local
    master, whose driver and executors are one process.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def number_within(settled: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, size: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps (long column ``name``), with the group's row count as ``size``.

    ``settled`` must be a checkpointed table: its partitions then hold the same
    rows whenever they are read. Each partition numbers its own rows of a group
    and adds the number of the group's rows in partitions before it, so no task
    ever holds more of a group than one partition has, however large the group.
    """
    tagged = settled.withColumn("__part", F.spark_partition_id())
    per_part = tagged.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("__n").over(Window.partitionBy(*keys)).alias(size)] if size else []
    starts = per_part.select("__part", *keys, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"), *whole)
    inside = Window.partitionBy("__part", *keys).orderBy(*order)
    local = tagged.withColumn("__at", F.row_number().over(inside).cast("long") - 1)
    joined = local.join(starts, ["__part", *keys])
    return joined.withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__start", "__at")
