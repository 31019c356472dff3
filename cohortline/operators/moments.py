"""Linear models from sufficient statistics of blocks of rows.

Least squares, with or without elastic net penalties, needs of its training rows
only the sums of products of their columns. One pass gathers these for every
block (a fold, an inner fold of an outer training set, a step of a learning
curve); any training set is a sum of blocks, so all fits of a nested search come
from that one pass, whatever the number of rows. The squared error on a block is
read off its sums, too.

A block's sums are a matrix of about ``features`` squared numbers. Tasks add up
their own rows, the partial sums meet row by row of the matrix, and fits run in
tasks, one for each outer fold. Coefficients (folds x inner folds x parameter
sets x features numbers) are the only thing that reaches the driver.

Nulls are filled by the mean of the training rows, features standardised by the
population sd of the filled training rows (a constant one by 1), as the
preparation stages of the other models do. For that, the sums also count where a
feature with nulls was observed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.scalar import nan_to_null
from cohortline.operators.folds import stratified_group_folds
from cohortline.operators.metrics import evaluate, get_metric
from cohortline.operators.rank import attach, tie_ranks
from cohortline.operators.rows import hash_order
from cohortline.operators.running import settle

_FITS = "outer int, inner int, set int, intercept double, slopes array<double>, fills array<double>, n double, sse double, held double"

#: Metrics that follow from a block's squared error, so that no row is scored to find them.
_FROM_SUMS = {"mse": lambda sse, n: sse / n, "rmse": lambda sse, n: float(np.sqrt(sse / n))}


@dataclass(frozen=True)
class Layout:
    """What the columns of the sums are: 1, label, features (shifted and scaled, 0 where null), observed flags."""

    features: tuple[str, ...]
    shift: tuple[float, ...]
    scale: tuple[float, ...]
    label_shift: float
    label_scale: float
    nullable: tuple[int, ...]

    def cells(self, label: str) -> list[Column]:
        def value(c: str) -> Column:
            return nan_to_null(F.col(c).cast("double"))

        scaled = [F.coalesce((value(c) - a) / b, F.lit(0.0)) for c, a, b in zip(self.features, self.shift, self.scale)]
        seen = [value(self.features[i]).isNotNull().cast("double") for i in self.nullable]
        return [F.lit(1.0), (F.col(label).cast("double") - self.label_shift) / self.label_scale, *scaled, *seen]


def layout(df: DataFrame, features: Sequence[str], label: str) -> Layout:
    """Centres and scales all products near 1, so that sums of blocks can be subtracted without loss."""
    cells = []
    for i, c in enumerate([*features, label]):
        x = nan_to_null(F.col(c).cast("double"))
        cells += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), (F.count(F.lit(1)) - F.count(x)).alias(f"z{i}")]
    row = df.agg(*cells).first()
    p = len(features)
    shift = [row[f"m{i}"] or 0.0 for i in range(p + 1)]
    scale = [row[f"s{i}"] or 1.0 for i in range(p + 1)]
    nullable = tuple(i for i in range(p) if row[f"z{i}"])
    return Layout(tuple(features), tuple(shift[:p]), tuple(scale[:p]), shift[p], scale[p], nullable)


def gather(df: DataFrame, label: str, shape: Layout, blocks: Column) -> DataFrame:
    """(block, part, sums): row ``part`` of each block's matrix of sums of products.

    ``blocks`` is an array of the block numbers that a row counts for. Rows
    without a label count for none.
    """
    q = 2 + len(shape.features) + len(shape.nullable)
    rows = df.filter(F.col(label).isNotNull()).select(blocks.cast("array<int>").alias("b"), *[c.alias(f"c{i}") for i, c in enumerate(shape.cells(label))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(q)])
            lists = batch.column(0)
            of = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(z)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for b in np.unique(of):
                some = z[at[of == b]]
                part = some.T @ some
                key = int(b)
                sums[key] = sums[key] + part if key in sums else part
        for key, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * q, pa.int32()), pa.array(range(q), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))],
                names=["block", "part", "sums"],
            )

    partial = rows.mapInArrow(add_up, "block int, part int, sums array<double>")
    total = partial.groupBy("block", "part").agg(Summarizer.sum(array_to_vector("sums")).alias("v"))
    return total.select("block", "part", vector_to_array("v").alias("sums"))


class Moments:
    """The matrix of a set of rows, and what follows from it."""

    def __init__(self, m: np.ndarray, shape: Layout):
        p = len(shape.features)
        self.n, self.x = m[0, 0], slice(2, 2 + p)
        seen = np.zeros(p, int)  # a feature's observed flag; the column of ones where there are no nulls
        seen[list(shape.nullable)] = np.arange(2 + p, m.shape[0])
        of = m[seen][:, self.x]
        counts = m[0, seen]
        self.mean = np.divide(m[0, self.x], counts, out=np.zeros(p), where=counts > 0)
        lifted = self.mean[:, None] * of
        self.xx = m[self.x, self.x] - lifted - lifted.T + np.outer(self.mean, self.mean) * m[np.ix_(seen, seen)]
        self.y_mean = m[0, 1] / self.n if self.n else 0.0
        self.xy = m[self.x, 1] - self.mean * m[seen, 1]
        middle = m[0, self.x] - self.mean * counts  # 0 but for rounding
        self.xy = self.xy - self.y_mean * middle
        sd = np.sqrt(np.maximum(np.diag(self.xx), 0) / max(self.n, 1))
        self.sd = np.where(sd > 1e-9, sd, 1.0)
        varies = sd > 1e-9
        self.gram = np.where(np.outer(varies, varies), self.xx / np.outer(self.sd, self.sd) / max(self.n, 1), 0.0)
        self.pull = np.where(varies, self.xy / self.sd / max(self.n, 1), 0.0)
        self.seen = seen

    def squared_error(self, weights: np.ndarray, m: np.ndarray) -> float:
        """Sum of squares of label minus weighted columns over the rows of ``m``; ``weights`` has a cell per column of it."""
        w = -weights
        w[1] = 1.0
        return float(max(w @ m @ w, 0.0))

    def columns(self, b: np.ndarray, size: int) -> np.ndarray:
        """Weights of the columns of the sums that predict with standardised slopes ``b``."""
        w = np.zeros(size)
        slopes = b / self.sd
        w[self.x] = slopes
        w[0] = self.y_mean
        np.add.at(w, self.seen, -slopes * self.mean)  # nulls stand at the mean, where they add nothing
        return w


def descend(gram: np.ndarray, pull: np.ndarray, first: float, second: float, start: np.ndarray, tol: float = 1e-13) -> np.ndarray:
    """Minimises b'Gb/2 - p'b + first |b|_1 + second/2 |b|^2 by coordinate descent, on the coordinates that move.

    Without penalties the least-squares solution of smallest norm is returned.
    """
    if first == 0 and second == 0:
        return np.linalg.lstsq(gram, pull, rcond=1e-12)[0]
    b, own = start.copy(), np.diag(gram)
    left = pull - gram @ b
    every = np.arange(len(b))
    active = every
    while True:
        moved = 0.0
        for i in active:
            if own[i] == 0:
                continue
            raw = left[i] + own[i] * b[i]
            new = np.sign(raw) * max(abs(raw) - first, 0.0) / (own[i] + second)
            step = new - b[i]
            if step:
                left -= gram[:, i] * step
                b[i] = new
                moved = max(moved, abs(step))
        if moved <= tol * max(1.0, np.abs(b).max(initial=0.0)):
            if len(active) == len(every):
                return b
            active = every
        else:
            active = np.flatnonzero(b) if len(active) == len(every) else active


def _raw(train: Moments, b: np.ndarray, shape: Layout) -> tuple[float, list[float], list[float]]:
    """Intercept, slopes and fill values for unscaled features and label."""
    scale, shift = np.array(shape.scale), np.array(shape.shift)
    slopes = b / train.sd / scale * shape.label_scale
    fills = train.mean * scale + shift
    return float(train.y_mean * shape.label_scale + shape.label_shift - slopes @ fills), slopes.tolist(), fills.tolist()


def fit_blocks(stats: DataFrame, sets: DataFrame, shape: Layout, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Fits on sums of blocks: one row per (outer, inner, parameter set).

    ``sets`` (outer, inner, block, use) says which blocks a fit trains on (use
    "train") and is scored on ("test"); a block counted in both of an outer fold's
    fits is sent there once. ``grid`` holds (alpha, l1_ratio); alpha 0 is least
    squares. ``sse`` and ``held`` are the squared error and the number of the
    test rows. A fit without training rows is left out.
    """
    wanted = [(r["outer"], r["inner"], r["block"], r["use"]) for r in sets.collect()]  # folds x inner folds x blocks numbers
    by_outer: dict[int, dict[int, dict[str, list[int]]]] = {}
    for o, i, b, use in wanted:
        by_outer.setdefault(o, {}).setdefault(i, {"train": [], "test": []})[use].append(b)
    needed = sets.select("outer", "block").distinct()
    # every set of parameters walks from the strongest penalty down, which starts each descent near its end
    order = sorted(range(len(grid)), key=lambda g: (grid[g][1], -grid[g][0]))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        outer, found = int(pdf["outer"].iloc[0]), {}
        for b, rows in pdf.groupby("block"):
            found[int(b)] = np.vstack(rows.sort_values("part")["sums"].to_list())
        out = []
        for inner, parts in sorted(by_outer[outer].items()):
            train = sum((found[b] for b in parts["train"] if b in found), np.zeros(()))
            if not train.shape:
                continue
            test = sum((found[b] for b in parts["test"] if b in found), np.zeros_like(train))
            m, last = Moments(train, shape), None
            for g in order:
                alpha, ratio = grid[g]
                # a label scaled to sd 1 has penalties scaled alike: the first by the label's scale, the second not at all
                if last is None or last[0] != ratio:
                    last = (ratio, np.zeros(len(shape.features)))
                b = descend(m.gram, m.pull, alpha * ratio / shape.label_scale, alpha * (1 - ratio), last[1])
                last = (ratio, b)
                sse = m.squared_error(m.columns(b, len(train)), test) * shape.label_scale**2
                out.append((outer, inner, g, *_raw(m, b, shape), float(m.n), sse, float(test[0, 0])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FITS.split(", ")])

    return stats.join(F.broadcast(needed), "block").groupBy("outer").applyInPandas(fit, _FITS)


def predicted(features: Sequence[str], slopes: str = "slopes", fills: str = "fills", intercept: str = "intercept") -> Column:
    """The prediction of a fit whose row has been joined."""
    out = F.col(intercept)
    for i, c in enumerate(features):
        out = out + F.coalesce(nan_to_null(F.col(c).cast("double")), F.get(fills, F.lit(i))) * F.get(slopes, F.lit(i))
    return out


@dataclass
class LinearRun:
    """Out-of-fold predictions, the chosen fit of every fold (``fits``) and the score of every parameter set."""

    predictions: DataFrame
    fits: DataFrame
    tuning: DataFrame


#: How a fit orders the rows of its inner fold: outer, inner, features (numbers), their slopes, and fills for nulls.
Direction = tuple[int, int, tuple[int, ...], tuple[float, ...], tuple[float, ...]]


def direction(outer: int, inner: int, slopes: Sequence[float], fills: Sequence[float]) -> Direction | None:
    """Fits with the same slopes order rows alike, as do fits with one feature and slopes of one sign; without slopes nothing is ordered."""
    active = tuple(i for i, b in enumerate(slopes) if b != 0)
    if not active:
        return None
    used = tuple(float(np.sign(slopes[i])) if len(active) == 1 else float(slopes[i]) for i in active)
    return outer, inner, active, used, tuple(float(fills[i]) for i in active)


def along(order: Direction, columns: Sequence[np.ndarray]) -> np.ndarray:
    """The scores that order rows: predictions without their intercept, which moves no rank."""
    parts = [b * np.where(np.isnan(columns[i]), v, columns[i]) for i, b, v in zip(*order[2:])]
    return sum(parts[1:], parts[0])


#: Rows of a slice of one order on average, sampled rows for each, sampled rows at most (slices grow beyond), label ranks that are broadcast, and values a task holds.
SLICE_ROWS, SLICE_SAMPLES, MAX_SAMPLES, MAX_RANKS, HELD = 1_000_000, 20, 200_000, 200_000, 1_000_000

_CELL = "d int, slice int, p array<double>, n array<double>, r array<double>, rr double, low double, high double"
_SUMS = "d int, slice int, n double, a double, aa double, b double, ab double, bb double, low double, high double, b_low double, b_high double"


def rank_scores(rows: DataFrame, fits: DataFrame, features: int) -> DataFrame:
    """Spearman rho of every searched fit on its inner test rows: outer, inner, set, score.

    ``rows`` has outer, inner, __row, __y and the features __f0, __f1, ... Each
    order of rows (``Direction``) is ranked once. A label's rank is looked up
    before rows meet the fits; tasks collect scores and label ranks by slice of
    each order, ties added up, and a slice is sorted as arrays. What leaves a slice
    is sums, to which the number of rows in lower slices adds its part.
    """
    spark, names = rows.sparkSession, [f"__f{i}" for i in range(features)]
    rows = rows.dropna(subset=["__y"])
    searched = fits.filter("inner > 0 and held > 0").collect()  # folds x inner folds x sets rows
    places = [(r["outer"], r["inner"], r["set"], direction(r["outer"], r["inner"], r["slopes"], r["fills"])) for r in searched]
    orders = list(dict.fromkeys(d for *_, d in places if d is not None))
    number = {d: i for i, d in enumerate(orders)}
    sets = spark.createDataFrame([(o, i, s, number.get(d, -1)) for o, i, s, d in places], "outer int, inner int, set int, d int")
    if not orders:
        return sets.select("outer", "inner", "set", F.lit(None).cast("double").alias("score"))
    by_group: dict[tuple[int, int], list[int]] = {}
    for i, d in enumerate(orders):
        by_group.setdefault(d[:2], []).append(i)

    per_sample = float(SLICE_ROWS // SLICE_SAMPLES)
    unit = F.xxhash64("outer", "inner", "__row") / F.lit(float(2**64)) + F.lit(0.5)
    picked = rows.withColumn("__u", unit).filter(F.col("__u") < 1.0 / per_sample).orderBy("__u", "__row").limit(MAX_SAMPLES)
    sample = picked.select("outer", "inner", *names).toPandas()  # MAX_SAMPLES rows at most
    cuts = []
    for d in orders:
        some = sample[(sample["outer"] == d[0]) & (sample["inner"] == d[1])]
        at = np.sort(along(d, [some[c].to_numpy(float) for c in names]))
        cuts.append(np.unique(at[SLICE_SAMPLES - 1 :: SLICE_SAMPLES]))
    shared = spark.sparkContext.broadcast((orders, by_group, cuts))

    keys = ["outer", "inner"]
    counts = settle(rows.groupBy(*keys, "__y").agg(F.count(F.lit(1)).alias("w")))
    ranks = settle(tie_ranks(counts, keys, "__y", "w").select(*keys, "__y", F.col("rank_avg").alias("__r")))
    few = ranks.limit(MAX_RANKS + 1).count() <= MAX_RANKS
    ranked = rows.join(F.broadcast(ranks) if few else ranks, [*keys, "__y"]).select(*keys, "__r", *names)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, by_group, cuts = shared.value
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(8)]
            for i, parts in held.items():
                p, r = (np.concatenate(x) for x in zip(*parts))
                by = np.argsort(p, kind="stable")
                p, r = p[by], r[by]
                first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                ends, slices = np.r_[first[1:], len(p)], np.searchsorted(cuts[i], p[first], side="right")
                n, total = np.diff(np.r_[first, len(p)]).astype(float), np.add.reduceat(r, first)
                for a, b in zip(*_stretches(slices)):
                    own = r[first[a] : ends[b - 1]]
                    for column, value in zip(out, (i, slices[a], p[first[a:b]], n[a:b], total[a:b], own @ own, own.min(), own.max())):
                        column.append(value)
            held.clear()
            kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3, *[pa.float64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[c.split()[0] for c in _CELL.split(", ")])

        for batch in batches:
            outer, inner, r, *x = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(batch.num_columns))
            for (o, j), some in by_group.items():
                at = np.flatnonzero((outer == o) & (inner == j))
                if not len(at):
                    continue
                here = [c[at] for c in x]
                for i in some:
                    held.setdefault(i, []).append((along(orders[i], here), r[at]))
                    size += len(at)
            if size >= HELD:
                yield flush()
                size = 0
        yield flush()

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        p, n, r = (np.concatenate(pdf[c].to_list()) for c in "pnr")
        by = np.argsort(p, kind="stable")
        p, n, r = p[by], n[by], r[by]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        n, r = np.add.reduceat(n, first), np.add.reduceat(r, first)
        rank = np.cumsum(n) - n + (n + 1) / 2
        cells = (int(pdf["d"].iloc[0]), int(pdf["slice"].iloc[0]), n.sum(), n @ rank, n @ (rank * rank), r.sum(), rank @ r, pdf["rr"].sum(), p[0], p[-1], pdf["low"].min(), pdf["high"].max())
        return pd.DataFrame([cells], columns=[c.split()[0] for c in _SUMS.split(", ")])

    slices = ranked.mapInArrow(collect, _CELL).groupBy("d", "slice").applyInPandas(sums, _SUMS)  # as many rows as cuts and orders
    below = F.coalesce(F.sum("n").over(Window.partitionBy("d").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    n, a, aa, b, ab, c = (F.col(x) for x in ("n", "a", "aa", "b", "ab", "c"))
    placed = slices.withColumn("c", below).select("*", (a + c * n).alias("sa"), (aa + 2 * c * a + c * c * n).alias("saa"), (ab + c * b).alias("sab"))
    total, sa, sb = F.sum("n"), F.sum("sa"), F.sum("b")
    cov, va, vb = F.sum("sab") - sa * sb / total, F.sum("saa") - sa * sa / total, F.sum("bb") - sb * sb / total
    differ = (F.min("low") < F.max("high")) & (F.min("b_low") < F.max("b_high"))
    rho = placed.groupBy("d").agg(F.when(differ, F.try_divide(cov, F.sqrt(va * vb))).alias("score"))
    return sets.join(rho, "d", "left").select("outer", "inner", "set", "score")


def _stretches(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts.tolist(), [*starts[1:].tolist(), len(values)]


def nested_elastic_net(
    df: DataFrame, fold: str, folds: Sequence[int], row_id: str, label: str, features: Sequence[str],
    inner: Mapping[int, str], inner_k: int, grid: Sequence[tuple[float, float]], metric: str = "mse", name: str = "ElasticNet",
) -> LinearRun:
    """Grid search in every outer training set and out-of-fold predictions, from one pass over the rows.

    ``inner`` names, for each outer fold, the column of its inner fold numbers
    (1 to ``inner_k``). The best set has the best mean score over inner folds (at
    ten decimals), the first of equal ones. Squared-error metrics come from the sums; Spearman's rho
    ranks every order of rows once (``rank_scores``); any other metric scores each inner fold's rows by all sets in a second pass.
    """
    folds = list(folds)
    known = df.filter(F.col(label).isNotNull())
    shape = layout(known, features, label)
    number = {k: i for i, k in enumerate(folds)}

    def block(k: int, j: int) -> int:
        return number[k] * inner_k + j - 1

    of_fold = [F.when(F.col(fold) != k, F.lit(number[k] * inner_k) + F.col(inner[k]).cast("int") - 1) for k in folds]
    stats = gather(known, label, shape, F.filter(F.array(*of_fold), lambda b: b.isNotNull()))
    spark = df.sparkSession
    wanted = []
    for k in folds:
        wanted += [(k, 0, block(k, j), "train") for j in range(1, inner_k + 1)]
        if len(grid) > 1:
            for j in range(1, inner_k + 1):
                wanted += [(k, j, block(k, i), "test" if i == j else "train") for i in range(1, inner_k + 1)]
    sets = spark.createDataFrame(wanted, "outer int, inner int, block int, use string")
    fits = spark.createDataFrame(fit_blocks(stats, sets, shape, grid).collect(), _FITS)  # folds x (inner folds + 1) x sets rows

    if metric in _FROM_SUMS:
        error = F.col("sse") / F.col("held")
        scores = fits.filter("inner > 0 and held > 0").select("outer", "inner", "set", (F.sqrt(error) if metric == "rmse" else error).alias("score"))
    else:
        own = F.filter(F.array(*[F.when(F.col(fold) != k, F.struct(F.lit(k).alias("outer"), F.col(inner[k]).cast("int").alias("inner"))) for k in folds]), lambda x: x.isNotNull())
        cells = [nan_to_null(F.col(c).cast("double")).alias(f"__f{i}") for i, c in enumerate(features)]
        rows = known.select(F.col(row_id).alias("__row"), F.col(label).cast("double").alias("__y"), *cells, F.inline(own))
        if metric == "spearman":
            scores = rank_scores(rows, fits, len(features))
        else:
            searched = fits.filter("inner > 0").groupBy("outer", "inner").agg(F.collect_list(F.struct("set", "intercept", "slopes", "fills")).alias("__sets"))
            names = [f"__f{i}" for i in range(len(features))]
            rows = rows.join(F.broadcast(searched), ["outer", "inner"]).select("outer", "inner", "__y", *names, F.inline("__sets"))
            rows = rows.withColumn("p", predicted(names))
            scores = evaluate(rows, "__y", "p", [metric], ["outer", "inner", "set"]).select("outer", "inner", "set", F.col(metric).alias("score"))
    means = scores.groupBy("outer", "set").agg(F.avg("score").alias("score")).collect()  # folds x sets rows
    sign = -1.0 if get_metric(metric).better == "max" else 1.0
    best = {k: 0 for k in folds}
    for k in folds:
        own = [(round(sign * r["score"], 10), r["set"]) for r in means if r["outer"] == k and r["score"] is not None]
        if own:
            best[k] = min(own)[1]
    table = [(r["outer"], r["set"], float(grid[r["set"]][0]), float(grid[r["set"]][1]), r["score"], best[r["outer"]] == r["set"]) for r in means]
    tuning = spark.createDataFrame(table, "fold int, set int, alpha double, l1_ratio double, score double, best boolean")
    chosen = spark.createDataFrame(list(best.items()), "outer int, set int")
    final = fits.filter("inner = 0").join(F.broadcast(chosen), ["outer", "set"])
    coefficients = F.broadcast(final.select(F.col("outer").alias("__outer"), "intercept", "slopes", "fills"))
    joined = known.join(coefficients, F.col(fold) == F.col("__outer"))
    out = joined.select(
        F.col(row_id).alias("id"), F.lit(name).alias("Model"), F.lit(label).alias("Label"), F.col(label).cast("double").alias("True_value"),
        predicted(features).alias("Predicted_value"), F.col(fold),
    )
    return LinearRun(out, final, tuning)


def inner_group_folds(
    df: DataFrame, fold: str, folds: Sequence[int], group: str, label: str, inner_k: int = 5, bins: int = 10, seed: int = 3748
) -> tuple[DataFrame, dict[int, str]]:
    """``df`` with a column of inner fold numbers for each outer fold, groups kept whole, and the columns' names."""
    names, every = {}, None
    for k in folds:
        names[k] = f"__inner{k}"
        train = df.filter((F.col(fold) != k) & F.col(label).isNotNull())
        inner = stratified_group_folds(train, group, label, inner_k, bins=bins, seed=seed).select(group, F.lit(k).alias("__k"), "fold")
        every = inner if every is None else every.unionByName(inner)
    wide = every.groupBy(group).agg(*[F.max(F.when(F.col("__k") == k, F.col("fold"))).alias(names[k]) for k in folds])
    return settle(attach(df, wide, [group], "left")), names


def linear_learning_curve(
    df: DataFrame, fold: str, folds: Sequence[int], row_id: str, label: str, features: Sequence[str],
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), unit: Column | None = None, seed: int = 17,
) -> DataFrame:
    """Mean and sd over folds of the rmse of least squares on growing training sets: train_share, score_mean, score_sd, folds.

    A row falls into the first size above its ``unit``, a number from 0 to 1 (by
    default a hash of its id). Training sets are sums over the sizes up to theirs,
    so one pass serves all fits.
    """
    folds, sizes = list(folds), sorted(sizes)
    known = df.filter(F.col(label).isNotNull())
    shape = layout(known, features, label)
    if unit is None:
        unit = F.pmod(hash_order(seed, row_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    step = sum(((unit >= s).cast("int") for s in sizes), F.lit(0))
    place = F.lit(None).cast("int")
    for i, k in enumerate(folds):
        place = F.when(F.col(fold) == k, i).otherwise(place)
    steps = len(sizes) + 1  # the last one is trained on by none, but scored
    stats = gather(known.filter(place.isNotNull()), label, shape, F.array(place * steps + step))
    wanted = []
    for i, k in enumerate(folds):
        for s in range(len(sizes)):
            wanted += [(k, s, j * steps + t, "train") for j in range(len(folds)) if j != i for t in range(s + 1)]
            wanted += [(k, s, i * steps + t, "test") for t in range(steps)]
    sets = df.sparkSession.createDataFrame(wanted, "outer int, inner int, block int, use string")
    scored = fit_blocks(stats, sets, shape, [(0.0, 0.0)]).filter("held > 0").withColumn("rmse", F.sqrt(F.col("sse") / F.col("held")))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in sizes]), F.col("inner") + 1)
    return scored.groupBy(share.alias("train_share")).agg(
        F.avg("rmse").alias("score_mean"), F.stddev_pop("rmse").alias("score_sd"), F.count("rmse").alias("folds")
    )
