"""Permutation baselines: labels shuffled over everyone or within a subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators.rank import attach
from cohortline.operators.rows import hash_order
from cohortline.operators.running import row_positions


def shuffle_label(
    df: DataFrame,
    row_id: str,
    label: str,
    name: str,
    within: Sequence[str] = (),
    order: Sequence[str] | None = None,
    seed: int = 17,
) -> DataFrame:
    """Reassign the non-null labels among the labelled rows (of each subject).

    Row k in id order receives the label of row k in shuffled order. Both
    positions come from the sliced running sum, so one subject may be any size.
    ``order`` replaces the seeded hash by explicit columns.
    """
    labelled = df.filter(F.col(label).isNotNull()).select(*dict.fromkeys([*within, row_id, label, *(order or [])]))
    takers = row_positions(labelled.select(*within, row_id), within, [row_id], "__pos")
    if order is None:
        mixed = labelled.withColumn("__mix", hash_order(seed, row_id))
        donors = row_positions(mixed, within, ["__mix", row_id], "__pos")
    else:
        donors = row_positions(labelled, within, [*order, row_id] if row_id not in order else order, "__pos")
    moved = attach(takers, donors.select(*within, "__pos", F.col(label).alias(name)), [*within, "__pos"])
    return attach(df, moved.select(row_id, name), [row_id], "left")


def shuffle_train_labels(
    df: DataFrame, row_id: str, label: str, fold: str, test_fold: int, seed: int = 17, order: Sequence[str] | None = None
) -> DataFrame:
    """Shuffle the labels of the training rows of one fold; test labels stay."""
    train = df.filter(F.col(fold) != test_fold)
    mixed = shuffle_label(train, row_id, label, "__mixed", seed=seed, order=order).withColumn(label, F.col("__mixed")).drop("__mixed")
    return mixed.unionByName(df.filter(F.col(fold) == test_fold))


def with_baselines(df: DataFrame, row_id: str, label: str, subject: str, seed: int = 17) -> DataFrame:
    """Add ``<label>_shuffled`` and ``<label>_shuffledWithinSubject``."""
    everyone = shuffle_label(df, row_id, label, f"{label}_shuffled", seed=seed)
    return shuffle_label(everyone, row_id, label, f"{label}_shuffledWithinSubject", within=[subject], seed=seed + 1)
