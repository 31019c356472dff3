"""Feature blocks side by side, and windows of sparse text vectors.

A block gives cells (row, index, value) and the names of its indices. Blocks are
put side by side by adding to each the sizes of those before it. A row keeps its
cells that aren't 0, as (index, value) in order: a sparse vector of known size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.rank import attach
from cohortline.operators.running import row_positions, settle

CELLS = "array<struct<index:long,value:double>>"


def vocabulary(weights: DataFrame, term: str = "term") -> DataFrame:
    """(term, index): the distinct terms numbered from 0 in alphabetical order, the same for every table they are used on."""
    return row_positions(weights.select(term).distinct(), [], [term], "index")


def text_cells(weights: DataFrame, row_id: str, terms: DataFrame, term: str = "term", weight: str = "weight") -> DataFrame:
    """(row_id, index, value) of the terms that the vocabulary has."""
    return weights.join(terms, term).select(row_id, "index", F.col(weight).cast("double").alias("value"))


def dense_cells(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("index"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(row_id, F.inline(cells))


def gathered(cells: DataFrame, row_id: str, name: str = "cells") -> DataFrame:
    """One row per ``row_id`` with its cells other than 0 in order; a group is one row's own cells."""
    kept = cells.filter((F.col("value") != 0) & F.col("value").isNotNull())
    return kept.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias(name))


def union_blocks(df: DataFrame, row_id: str, blocks: Mapping[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Blocks side by side: (row_id, cells) for every row of ``df``, and the names (index, block, name).

    Each block is its cells (row_id, index, value) and its names (index, name).
    Names stay with the indices, whatever the blocks' sizes. Rows that a block
    lacks have no cells in it.
    """
    if not blocks:
        raise ValueError("at least one block")
    offset, cells, names = F.lit(0).cast("long"), None, None
    for block, (own, called) in blocks.items():
        moved = own.withColumn("index", F.col("index") + offset).select(row_id, "index", "value")
        listed = called.select((F.col("index") + offset).alias("index"), F.lit(block).alias("block"), F.col("name").cast("string").alias("name"))
        cells = moved if cells is None else cells.unionByName(moved)
        names = listed if names is None else names.unionByName(listed)
        offset = offset + called.agg(F.coalesce(F.max("index") + 1, F.lit(0)).alias("n")).scalar()
    out = attach(df.select(row_id), gathered(cells, row_id), [row_id], "left")
    return out.withColumn("cells", F.coalesce("cells", F.array().cast(CELLS))), names


def named_columns(columns: Sequence[str], df: DataFrame) -> DataFrame:
    """Names of a dense block."""
    return df.sparkSession.createDataFrame(list(enumerate(columns)), "index long, name string")


def union_steps(df: DataFrame, columns: Sequence[str], name: str = "steps") -> DataFrame:
    """Sequences side by side along the feature axis, step by step; they must be of one length."""
    first, *others = columns
    out = F.col(first)
    for c in others:
        same = F.size(out) == F.size(c)
        joined = F.zip_with(out, F.col(c), lambda a, b: F.concat(a, b))
        out = F.when(same, joined).otherwise(F.raise_error(F.lit(f"{c} has another number of steps")).cast("array<array<double>>"))
    return df.withColumn(name, out)


def text_windows(
    df: DataFrame, row_id: str, keys: Sequence[str], order: Sequence[str], cells: DataFrame, size: int = 3
) -> DataFrame:
    """(row_id, steps): for each row the sparse vectors of the last ``size`` rows of its group, the row itself last.

    ``cells`` (row_id, index, value) come from one vocabulary, so all steps and
    windows share its indices. Steps before a group's first row are empty. A row's
    vector is sent to the ``size`` windows it is in, by group and position; no
    task holds more of a group than one window.
    """
    if size < 1:
        raise ValueError("a window has at least one step")
    placed = settle(row_positions(df.select(row_id, *keys, *[c for c in order if c not in keys and c != row_id]), list(keys), list(order), "__pos"))
    vectors = placed.select(row_id, *keys, "__pos").join(gathered(cells, row_id, "__cells"), row_id)
    ahead = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("__ahead")
    sent = vectors.select(*keys, "__pos", "__cells", ahead).select(
        *keys, (F.col("__pos") + F.col("__ahead")).alias("__pos"), (F.lit(size - 1) - F.col("__ahead")).alias("__step"), "__cells"
    )
    ends = placed.select(row_id, *keys, "__pos")
    met = attach(sent, ends, [*keys, "__pos"])
    listed = met.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("__step", "__cells"))).alias("__m"))
    out = attach(df.select(row_id), listed, [row_id], "left")
    empty = F.array().cast(CELLS)
    steps = F.array(*[F.coalesce(F.element_at("__m", F.lit(i)), empty) for i in range(size)])
    return out.select(row_id, steps.alias("steps"))


def step_rows(windows: DataFrame, row_id: str) -> DataFrame:
    """(row_id, step, index, value): the cells of all windows, one a row."""
    steps = windows.select(row_id, F.posexplode("steps").alias("step", "__cells"))
    return steps.select(row_id, "step", F.inline("__cells"))


def dense(cells: Column, size: int) -> Column:
    """A short sparse row as an array of ``size`` numbers."""
    held = F.map_from_entries(cells)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(held, i.cast("long")), F.lit(0.0)))
