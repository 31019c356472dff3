"""Reading study files: CSV (plain or gzip), key=value lookups, column lists, result folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from cohortline.operators.rows import safe_names


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    null_value: str = "",
    dotted_names: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """CSV with header, also gzip. NaN becomes NULL, dots in names become underscores.

    A gzip file is one task, so give ``partitions`` to spread what follows.
    Without a schema the types are inferred, which reads the file once more.
    """
    reader = spark.read.option("header", True).option("nullValue", null_value).option("nanValue", "NaN")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path if isinstance(path, str) else list(path))
    if not dotted_names:
        df = safe_names(df)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    if floats:
        df = df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})
    return df.repartition(partitions) if partitions else df


def from_frame(df: DataFrame, row_id: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """An existing DataFrame as source, optionally with a fresh dense row id."""
    if row_id is None:
        return df
    from cohortline.operators.rows import assign_ids

    return assign_ids(df, order, row_id)


def read_key_values(spark: SparkSession, path: str, key: str = "key", value: str = "value", key_type: str = "long") -> DataFrame:
    """``key=value`` lines; broken lines are dropped."""
    line = F.split(F.trim("value"), "=", 2)
    rows = spark.read.text(path).select(line.alias("p")).filter(F.size("p") == 2)
    return rows.select(F.trim(F.get("p", F.lit(0))).try_cast(key_type).alias(key), F.trim(F.get("p", F.lit(1))).alias(value)).filter(F.col(key).isNotNull())


def read_column_list(spark: SparkSession, path: str) -> list[str]:
    """One column name per line (a file as long as a schema is wide)."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).filter(F.length("v") > 0).collect()
    return [r["v"].replace(".", "_") for r in rows]


def with_path_tags(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Columns cut out of the file path by one-group patterns, e.g. ``fold=r'/fold(\\d+)/'``."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, pattern, 1).alias(name) for name, pattern in tags.items()])


def read_union(
    spark: SparkSession, layouts: Sequence[str], tags: Mapping[str, str] | None = None, null_value: str = "NA"
) -> DataFrame:
    """Files of several layouts (one glob each) as one table with sorted columns; missing ones NULL."""
    out = None
    for glob in layouts:
        raw = spark.read.option("header", True).option("nullValue", null_value).option("inferSchema", True).csv(glob)
        part = with_path_tags(raw, tags) if tags else raw
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def read_hyperparameters(
    spark: SparkSession, path: str, keys: Sequence[str], tags: Mapping[str, str] | None = None
) -> DataFrame:
    """``name: value`` lines; one row per file with the wanted names, NULL where absent."""
    lines = with_path_tags(spark.read.text(path), {"file": r"([^/]+)$", **(tags or {})})
    pairs = lines.select(
        "file", *(tags or {}),
        F.regexp_extract("value", r"^\s*([^:]+?)\s*:", 1).alias("k"),
        F.regexp_extract("value", r":\s*(.*?)\s*$", 1).alias("v"),
    )
    groups = ["file", *(tags or {})]
    return pairs.groupBy(*groups).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in keys])
