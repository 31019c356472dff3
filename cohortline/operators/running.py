"""Running aggregates inside groups of any size.

``Window.partitionBy(subject)`` puts a whole subject into one task, and a window
without ``partitionBy`` puts the whole table there. Ranks, row positions,
ROC curves, medians, label shuffles and fold numbers all need an ordered pass,
so they share the one operator below, which never needs a task larger than a
slice of a group:

1. Cut points: a hash-selected sample of the order values, one for about
   ``ROWS_PER_SLICE`` rows, so a group gets cuts in proportion to its size and
   groups below that size mostly none. Beyond ``MAX_CUTS`` of them in the whole
   table slices grow instead, which bounds what is broadcast. The selection
   depends on values only, so a recomputed task sees the same cuts.
2. Every row finds its slice by binary search in its group's cuts.
3. One window per (group, slice).
4. Slice totals exist only for groups with cuts (at most twice the number of
   cuts), are accumulated in a second, tiny window and broadcast back.

The result does not depend on where the cuts fall; they only spread the work.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_KEY = "spark.cohortline.slices.rows"

#: Rows that a slice holds on average, and the number of cuts from which on slices grow with the table.
ROWS_PER_SLICE, MAX_CUTS = 20_000, 100_000

_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def spread(df: DataFrame) -> DataFrame:
    """Deal narrow rows with heavy per-row work (tokenising, exploding) over all shuffle partitions.

    One split of a scan otherwise feeds the whole explosion to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


_SHUFFLING = re.compile(r"^[\s:+\-|]*(Join|Aggregate|Window|Sort|Repartition\w*)\b", re.MULTILINE)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a derived table before it is read several times.

    Plain scans with projections and filters are cheaper to read again, and so
    stay as they are. The folder is the cluster's ``spark.checkpoint.dir``. Where
    none is set, a local master, whose driver and executors are one process, uses
    a temporary folder, and on a cluster the table is recomputed.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if not _SHUFFLING.search(plan):
        return df
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.startswith("local["):
            shared = tempfile.mkdtemp(prefix="checkpoints-", dir="/tmp")
        if not shared:
            return df
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


#: Steps of a binary search in a group's cuts; there are MAX_CUTS of them but for chance.
_STEPS = [1 << i for i in range((2 * MAX_CUTS).bit_length(), -1, -1)]


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def slice_rows(spark: SparkSession) -> float:
    return float(spark.conf.get(ROWS_KEY, str(ROWS_PER_SLICE)))


def _cuts(source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rows = slice_rows(source.sparkSession)
    unit = F.xxhash64(*[F.col(c) for c in (*keys, *order)]) / F.lit(float(2**64)) + F.lit(0.5)
    picked = source.filter(unit < 1.0 / rows).select(*keys, _order_struct(order).alias("__at"), unit.alias("__unit")).distinct()
    # The smallest hashes stay, which is a smaller share of every group alike; one pass over the rows serves count and sample.
    picked = picked.orderBy("__unit", "__at").limit(MAX_CUTS)
    return picked.groupBy(*keys).agg(F.sort_array(F.collect_list("__at")).alias("__cuts"))


def with_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    source: DataFrame | None = None,
    as_name: str = "__slice",
) -> DataFrame:
    """Add a slice number that grows with ``order`` inside each group.

    ``source`` may name a cheaper table with the same keys and order values to
    take the cuts from (usually the rows before an aggregation).
    """
    cuts = _cuts(source if source is not None else df, keys, order)
    if keys:
        right = cuts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__cuts")
        on = None
        for i, k in enumerate(keys):
            same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
            on = same if on is None else on & same
        df = df.join(F.broadcast(right), on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    else:
        df = df.withColumn("__cuts", cuts.select("__cuts").scalar())
    me = _order_struct(order)
    steps = F.array(*[F.lit(s) for s in _STEPS])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(F.get(F.col("__cuts"), low + step - 1) <= me, low + step).otherwise(low),
    )
    has_cuts = F.coalesce(F.size("__cuts"), F.lit(0)) > 0
    return df.withColumn(as_name, F.when(has_cuts, found).otherwise(F.lit(0)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, tuple],
    descending: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Exclusive running aggregates: for each row, over the rows before it in its group.

    ``measures`` maps a new column to ``(kind, column)`` with kind sum, max or
    min; ``(kind, column, "after")`` looks at the rows behind instead. ``order``
    must be unique inside a group (aggregate ties first). Sums start at 0,
    max/min at NULL. ``descending`` walks from the largest row.
    """
    names = list(measures)
    kind = {n: measures[n][0] for n in names}
    backwards = {n: (len(measures[n]) > 2) != descending for n in names}

    def frame(group: list[str], by: Sequence[str], back: bool):
        columns = [F.col(c).desc() if back else F.col(c).asc() for c in by]
        base = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        return base.orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)

    if source is None:
        df = settle(df)
    columns = df.columns
    prepared = with_slices(df, keys, order, source)
    prepared = prepared.withColumns({f"__m_{n}": measures[n][1] for n in names})
    inside = [*keys, "__slice"]
    local = prepared.withColumns(
        {f"__l_{n}": _FOLDS[kind[n]](f"__m_{n}").over(frame(inside, order, backwards[n])) for n in names}
    )
    totals = (
        prepared.filter(F.size("__cuts") > 0)
        .groupBy(*inside)
        .agg(*[_FOLDS[kind[n]](f"__m_{n}").alias(f"__t_{n}") for n in names])
    )
    carried = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__slice").alias("__s"),
        *[_FOLDS[kind[n]](f"__t_{n}").over(frame(list(keys), ["__slice"], backwards[n])).alias(f"__c_{n}") for n in names],
    )
    on = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = local.join(F.broadcast(carried), on, "left")

    def combined(name: str) -> Column:
        here, carry = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind[name] == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return (F.greatest if kind[name] == "max" else F.least)(here, carry)

    return joined.select(*columns, *[combined(n).alias(n) for n in names])


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    descending: bool = False,
) -> DataFrame:
    """Zero-based dense position of each row in its group (long)."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, descending)


def ntile_of(pos: Column, total: Column, tiles: int) -> Column:
    """SQL ``ntile`` (zero-based) from a position and a row count."""
    base = F.floor(total / tiles)
    extra = total - base * tiles
    edge = extra * (base + 1)
    return F.when(pos < edge, F.floor(pos / (base + 1))).otherwise(
        extra + F.floor((pos - edge) / F.greatest(base, F.lit(1)))
    ).cast("int")
