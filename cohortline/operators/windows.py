"""Fixed-length sequences of the last rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.scalar import pad_left
from cohortline.operators.rank import varies
from cohortline.operators.running import row_positions

CHUNK_ROWS = 200_000


def sliding_lists(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], size: int, name: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Array of the last ``size`` rows (each an array of ``columns``) up to the current row.

    Large groups are cut into chunks by row position. The last ``size - 1`` rows
    of a chunk are copied into the next one, so no chunk misses its history.
    """
    step = F.array(*[F.col(c).cast("double") for c in columns])
    chunk = F.floor(F.col("__pos") / chunk_rows)
    spill = F.pmod(F.col("__pos"), F.lit(chunk_rows)) >= chunk_rows - (size - 1)
    copies = F.when(spill, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    placed = row_positions(df, keys, order, "__pos").withColumn("__home", chunk).withColumn("__chunk", F.explode(copies))
    frame = Window.partitionBy(*keys, "__chunk").orderBy("__pos").rowsBetween(-(size - 1), 0)
    listed = placed.withColumn(name, F.collect_list(step).over(frame))
    return listed.filter(F.col("__chunk") == F.col("__home")).drop("__pos", "__home", "__chunk")


def sliding_windows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], size: int = 3,
    name: str = "steps", pad: bool = True,
) -> DataFrame:
    """Windows padded with zero steps in front. ``order`` must be unique inside a group."""
    out = sliding_lists(df, keys, order, columns, size, name)
    if not pad:
        return out
    blank = F.array_repeat(F.lit(0.0), len(columns))
    return out.withColumn(name, pad_left(F.col(name), size, blank))


def sequences_with_label(
    df: DataFrame, row_id: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], label: str, size: int = 3
) -> DataFrame:
    """``(row_id, steps, label of the last step)``; the row id keeps rows identifiable without re-sorting."""
    return sliding_windows(df, keys, order, columns, size).select(row_id, "steps", F.col(label).alias("label"))


def scale_sequences(df: DataFrame, steps: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise every feature over all rows and steps of the fitting rows."""
    cells = (fit_on if fit_on is not None else df).select(F.explode(steps).alias("step")).select(F.posexplode("step").alias("f", "v"))
    stats = cells.groupBy("f").agg(F.avg("v").alias("m"), F.when(varies(F.col("v")), F.stddev_pop("v")).otherwise(0.0).alias("s"))
    table = stats.agg(F.sort_array(F.collect_list(F.struct("f", "m", "s"))).alias("stats")).scalar()
    with_stats = df.withColumn("__stats", table)

    def scaled(step):
        def one(v, i):
            s = F.get(F.col("__stats"), i)
            return (v - s["m"]) / F.when(s["s"] == 0, 1.0).otherwise(s["s"])
        return F.transform(step, one)

    return with_stats.withColumn(steps, F.transform(steps, scaled)).drop("__stats")
