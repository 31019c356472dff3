"""Leakage-safe fold assignment: long tables of ``(row or group, fold)``, folds from 1."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.rank import attach
from cohortline.operators.rows import hash_order
from cohortline.operators.running import ntile_of, row_positions


def _ordered(df: DataFrame, ids: Sequence[str], order: Sequence[str] | None, seed: int | None) -> tuple[DataFrame, list[str]]:
    if order is not None:
        return df, [*order, *[c for c in ids if c not in order]]
    if seed is None:
        return df, list(ids)
    return df.withColumn("__mix", hash_order(seed, *ids)), ["__mix", *ids]


def k_folds(df: DataFrame, row_id: str, k: int, seed: int | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Contiguous folds over the id (or a given order), or seeded random ones; sizes differ by at most 1."""
    base, by = _ordered(df.select(*dict.fromkeys([row_id, *(order or [])])), [row_id], order, seed)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = row_positions(base, [], by)
    return placed.select(row_id, (ntile_of(F.col("pos"), total, k) + 1).alias("fold"))


def _serpentine(pos: Column, k: int) -> Column:
    lap, step = F.floor(pos / k), F.pmod(pos, F.lit(k))
    return (F.when(lap % 2 == 0, step).otherwise(k - 1 - step) + 1).cast("int")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Whole groups per fold with balanced row counts: ``(group, n, fold)``.

    Groups are dealt by size rank, back and forth, however many there are.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    placed = row_positions(sizes.withColumn("__rank", -F.col("n")), [], ["__rank", group])
    return placed.select(group, "n", _serpentine(F.col("pos"), k).alias("fold"))


def percentile_bin(df: DataFrame, row_id: str, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Equal-count bins of the value (ties split by row id): ``(row_id, bin)``, bins from 0."""
    known = df.filter(F.col(value).isNotNull()).select(row_id, value)
    total = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = row_positions(known, [], [value, row_id])
    return placed.select(row_id, ntile_of(F.col("pos"), total, bins).alias(name))


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of ascending edges at or below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value >= F.lit(e), 1).otherwise(0)
    return F.when(value.isNotNull(), out)


def stratified_folds(
    df: DataFrame,
    row_id: str,
    value: str,
    k: int,
    bins: int | None = None,
    edges: Sequence[float] | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Deal the rows, bin after bin, round-robin over the folds: ``(row_id, bin, fold)``.

    Dealing goes on where the last bin stopped, so both the folds and every
    bin's share of them differ by at most one row.
    """
    if bins is not None:
        binned = percentile_bin(df, row_id, value, bins)
    elif edges is not None:
        binned = df.filter(F.col(value).isNotNull()).select(row_id, edge_bin(F.col(value), edges).alias("bin"))
    else:
        raise ValueError("give bins or edges")
    base, by = _ordered(binned, [row_id], None, seed)
    placed = row_positions(base, [], ["bin", *by])
    return placed.select(row_id, "bin", (F.pmod("pos", F.lit(k)) + 1).cast("int").alias("fold"))


def stratified_group_folds(
    df: DataFrame,
    group: str,
    value: str,
    k: int,
    bins: int | None = None,
    edges: Sequence[float] | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Stratify whole groups by the group's mean label: ``(group, bin, fold)``."""
    means = df.groupBy(group).agg(F.avg(value).alias("__mean"))
    return stratified_folds(means, group, "__mean", k, bins, edges, seed)


def folds_from_wide(wide: DataFrame, k: int, position: str = "pos", base: int = 1) -> DataFrame:
    """Wide ``FoldK_train`` / ``FoldK_test`` columns to ``(row_id, fold, split, position)``."""
    cells = F.array(*[
        F.struct(
            F.col(f"Fold{i}_{split}").cast("long").alias("row_id"),
            F.lit(i - base + 1).alias("fold"),
            F.lit(split).alias("split"),
        )
        for i in range(base, base + k)
        for split in ("train", "test")
    ])
    return wide.select(F.col(position).alias("position"), F.inline(cells)).filter(F.col("row_id").isNotNull())


def folds_to_wide(folds: DataFrame, row_id: str, k: int, ids: Sequence[str] | None = None) -> DataFrame:
    """Long ``(row_id, fold)`` to the wide, ragged, null-padded export form."""
    sides = F.transform(
        F.sequence(F.lit(1), F.lit(k)),
        lambda f: F.struct(f.alias("f"), F.when(F.col("fold") == f, "test").otherwise("train").alias("split")),
    )
    long = folds.select(row_id, F.inline(sides)).withColumn("column", F.format_string("Fold%d_%s", "f", "split"))
    placed = row_positions(long.select("column", row_id), ["column"], [row_id])
    names = [f"Fold{i}_{s}" for s in ("train", "test") for i in range(1, k + 1)]
    return placed.groupBy("pos").pivot("column", names).agg(F.first(row_id))


def key_folds(df: DataFrame, key: str, folds: DataFrame, row_id: str | None = None) -> DataFrame:
    """Distinct ``(key, test_fold)`` from a row or group fold table."""
    if row_id is not None:
        folds = attach(df.select(row_id, key), folds.select(row_id, "fold"), [row_id])
    return folds.select(key, F.col("fold").alias("test_fold")).distinct()


def with_fold(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Attach the fold number by row or group key."""
    return attach(df, folds.select(key, "fold"), [key])


def manual_split(df: DataFrame, is_test: Column, name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(is_test, "test").otherwise("train"))


def folds_for_labels(df: DataFrame, row_id: str, labels: Sequence[str], k: int, bins: int, seed: int | None) -> DataFrame:
    """Stratified folds for several label columns: ``(label, row_id, bin, fold)``."""
    out = None
    for label in labels:
        one = stratified_folds(df, row_id, label, k, bins=bins, seed=seed).select(
            F.lit(label).alias("label"), row_id, "bin", "fold"
        )
        out = one if out is None else out.unionByName(one)
    return out


def fold_plan(strategy: str, df: DataFrame, **args: object) -> DataFrame:
    """Named strategies, as an experiment description gives them."""
    plans: Mapping[str, object] = {
        "random": k_folds,
        "random_grouped": group_folds,
        "stratified": stratified_folds,
        "stratified_grouped": stratified_group_folds,
        "load_premade": folds_from_wide,
        "manual_train_test": manual_split,
    }
    if strategy not in plans:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(plans)}")
    return plans[strategy](df, **args)
