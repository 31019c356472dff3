"""Writing results: CSV in a fixed layout, partitioned results, fold tables, runs and models."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.scalar import record_json
from cohortline.operators.folds import folds_to_wide


def in_layout(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in a fixed order; those the table lacks are added as NULL text."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, null_text: str = "NA", mode: str = "errorifexists") -> None:
    """A folder of CSV parts with headers; ``mode='append'`` adds to an existing one."""
    out = in_layout(df, columns) if columns else df
    out.write.mode(mode).option("header", True).option("nullValue", null_text).option("emptyValue", "").csv(path)


def append_results(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Create the result table or add rows to it."""
    write_csv(df, path, columns, mode="append")


def write_results(df: DataFrame, path: str, keys: Sequence[str] = ("Model", "Label", "fold"), mode: str = "overwrite") -> None:
    """Results, predictions or confusion counts laid out by model, label and fold.

    Rows of a (model, label, fold) are brought together; adaptive execution
    splits a combination over as many tasks as its measured size asks for.
    """
    present = [k for k in keys if k in df.columns]
    df.hint("rebalance", *[F.col(k) for k in present]).write.mode(mode).partitionBy(*present).parquet(path)


def write_folds(folds: DataFrame, path: str, row_id: str, k: int, wide: bool = False, name: str | None = None) -> str:
    """The long fold table as parquet, or the wide ragged CSV for exchange."""
    target = f"{path}/{name}" if name else path
    if wide:
        write_csv(folds_to_wide(folds, row_id, k).orderBy("pos").drop("pos"), target, null_text="", mode="overwrite")
    else:
        folds.write.mode("overwrite").parquet(target)
    return target


def fold_file_name(strategy: str, stratify_on: str, bins: int | None, seed: int | None) -> str:
    """Name of a fold table from what made it."""
    parts = [strategy, stratify_on, f"bins{bins}" if bins is not None else None, f"seed{seed}" if seed is not None else None]
    return "_".join(p for p in parts if p)


def write_splits(df: DataFrame, fold: str, folds: Sequence[int], path: str) -> None:
    """Train and test rows of every fold, partitioned by fold and split."""
    sides = F.array(*[
        F.struct(F.lit(k).alias("for_fold"), F.when(F.col(fold) == k, "test").otherwise("train").alias("split")) for k in folds
    ])
    df.select("*", F.inline(sides)).write.mode("overwrite").partitionBy("for_fold", "split").parquet(path)


def write_features(df: DataFrame, features: Sequence[str], label: str, path: str) -> None:
    df.select(*features, label).write.mode("overwrite").parquet(path)


def save_run(tables: Mapping[str, object], folder: str, spark: SparkSession) -> None:
    """Save a named set of tables and plain values with a JSON manifest."""
    manifest = []
    for name, item in tables.items():
        if isinstance(item, DataFrame):
            item.write.mode("overwrite").parquet(f"{folder}/{name}")
            manifest.append((name, "table", json.dumps(item.columns)))
        elif hasattr(item, "write"):
            item.write().overwrite().save(f"{folder}/{name}")
            manifest.append((name, "model", json.dumps(type(item).__name__)))
        else:
            manifest.append((name, "value", json.dumps(item, default=str)))
    rows = spark.createDataFrame(manifest, "name string, kind string, content string")
    rows.select(record_json({c: F.col(c) for c in rows.columns}).alias("value")).write.mode("overwrite").text(f"{folder}/_manifest")


def load_run(folder: str, spark: SparkSession) -> dict[str, object]:
    """Tables and plain values of a saved run (models are loaded by their own class)."""
    rows = spark.read.text(f"{folder}/_manifest").select(
        F.from_json("value", "name string, kind string, content string").alias("m")
    ).select("m.*").collect()
    out: dict[str, object] = {}
    for r in rows:
        if r["kind"] == "table":
            out[r["name"]] = spark.read.parquet(f"{folder}/{r['name']}")
        elif r["kind"] == "value":
            out[r["name"]] = json.loads(r["content"])
    return out


def log_run(spark: SparkSession, path: str, run: str, model: str, label: str, fold: int | None, params: Mapping[str, object]) -> None:
    """Append one line to the table of runs."""
    row = [(run, model, label, fold, {k: str(v) for k, v in params.items()})]
    schema = "run string, model string, label string, fold int, params map<string,string>"
    spark.createDataFrame(row, schema).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
