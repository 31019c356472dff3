"""Projection, filtering and row-level edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortline.operators.rank import attach
from cohortline.operators.running import row_positions


def validate_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")


def project(df: DataFrame, columns: Sequence[str], numeric: bool = False) -> DataFrame:
    """Select a column list; ``numeric`` insists on number columns and casts them to double."""
    validate_columns(df, columns)
    if not numeric:
        return df.select(*[F.col(f"`{c}`") for c in columns])
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, NumericType)]
    if wrong:
        raise TypeError(f"not numeric: {', '.join(wrong)}")
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])


def safe_names(df: DataFrame) -> DataFrame:
    """Replace dots in column names (``stress.d`` becomes ``stress_d``)."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    return df.dropna(subset=[label])


def in_list_filters(df: DataFrame, filters: Mapping[str, Sequence[object]]) -> DataFrame:
    """Keep rows matching every column's list of values."""
    validate_columns(df, list(filters))
    for column, values in filters.items():
        df = df.filter(F.col(column).isin(list(values)))
    return df


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def drop_all_null(df: DataFrame, value_columns: Sequence[str]) -> DataFrame:
    """Drop rows in which every value column is null (key columns do not count)."""
    return df.dropna(how="all", subset=list(value_columns))


def assign_ids(df: DataFrame, order: Sequence[str], name: str = "id", start: int | Column = 0) -> DataFrame:
    """Dense row number over a unique order, from ``start``."""
    base = start if isinstance(start, Column) else F.lit(start).cast("long")
    return row_positions(df, [], order, "__pos").withColumn(name, F.col("__pos") + base).drop("__pos")


def append_with_new_ids(first: DataFrame, second: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Append ``second`` behind the largest id of ``first``; columns of ``first`` win."""
    top = first.agg((F.coalesce(F.max(name), F.lit(-1)) + 1).cast("long").alias("next")).scalar()
    numbered = assign_ids(second.drop(name), order, name, top)
    return align_union(first, numbered)


def align_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by name; columns ``second`` lacks become NULL, extra ones are dropped."""
    shared = [c for c in first.columns if c in second.columns]
    return first.unionByName(second.select(*shared), allowMissingColumns=True)


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def tag(df: DataFrame, **constants: object) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keep})


def fill_constants(df: DataFrame, number: float | None = None, text: str | None = None) -> DataFrame:
    if number is not None:
        df = df.fillna(number)
    return df if text is None else df.fillna(text)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``, with all columns.

    ``min_by`` keeps one candidate per key on the map side, so a key with many
    copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def drop_second_copy(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, order)


def copy_value_between_labels(
    df: DataFrame, keys: Sequence[str], label: str, value: str, source_label: str, target_label: str
) -> DataFrame:
    """Rows of ``target_label`` take ``value`` from the ``source_label`` row with the same keys."""
    donor = df.filter(F.col(label) == source_label).groupBy(*keys).agg(F.max(value).alias("__donor"))
    joined = attach(df, donor, list(keys), "left")
    updated = F.when(F.col(label) == target_label, F.col("__donor")).otherwise(F.col(value))
    return joined.withColumn(value, updated).drop("__donor")


def relabel(df: DataFrame, column: str, names: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Exact-match renaming of values through a names table; others stay."""
    table = names.select(F.col(old).alias(column), F.col(new).alias("__new"))
    return attach(df, table, [column], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def flatten_arrays(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """Array cells to numbered columns ``name_0 .. name_{n-1}``."""
    plain = [c for c in df.columns if c not in sizes]
    cells = [F.get(F.col(c), F.lit(i)).alias(f"{c}_{i}") for c, n in sizes.items() for i in range(n)]
    return df.select(*plain, *cells)


def hash_order(seed: int, *ids: str) -> Column:
    """Seeded pseudo-random sort key that survives recomputation."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])


def shuffled(df: DataFrame, ids: Sequence[str], seed: int) -> DataFrame:
    """Rows in seeded random order (a distributed range sort)."""
    return df.orderBy(hash_order(seed, *ids), *ids)
