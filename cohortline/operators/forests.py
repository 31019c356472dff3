"""Many regression forests grown together, one level at a time.

A forest of ``trees`` trees for each of many seeds is one table of trees. Each row
counts in a tree as often as a Poisson draw of mean 1 says (a bootstrap that needs
no second look at the rows); the draw is a hash of the row and the tree. One
aggregation over (tree, node, feature, bin) a level serves every tree of every
seed, so the number of jobs depends on the depth alone. Splits of all trees are
found side by side and go back to the rows by broadcast; a tree of depth d is an
array of at most 2^d - 1 splits, so their size is bounded by the parameters.

``fold_importances`` grows the forests of all folds together in the same way. Its
histograms are made in tasks, so no row is written once per tree: a level's pass
reads the rows and leaves sums by (tree, node, feature, bin).

Features are cut at up to ``bins - 1`` quantiles. A node tries ``tried`` features,
chosen by a hash of tree, node and feature, and takes the cut with the largest
decrease of the squared error (ties: the first feature, then the lowest cut).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.metrics import evaluate
from cohortline.operators.running import settle
from cohortline.operators.summary import five_numbers

#: Cumulative probabilities of a Poisson variable of mean 1 at 0, 1, 2, ... (beyond 9 fewer than one draw in a million).
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
            0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217)
_UNIT = float(1 << 53)


def _unit(*what) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(_UNIT)


def drawn(seed: int, row: Column, tree: Column) -> Column:
    """How often a row counts in a tree."""
    u = _unit(F.lit(seed), row, tree)
    return sum(((u >= p).cast("int") for p in _POISSON), F.lit(0))


def cut_points(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Up to ``bins - 1`` distinct quantiles of each feature, from one aggregate."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 100 * bins).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(len(features))]


def _side(node: Column) -> Column:
    """Child of a node on the row's side of its split (null where the node has none)."""
    split = F.get("__splits", node - 1)
    right = (F.get("__bins", split["feature"]) > split["cut"]).cast("int")
    return F.when(split["feature"].isNotNull(), node * 2 + right)


def _arrays(splits: DataFrame, size: int) -> DataFrame:
    """One row per tree: ``__splits``, of node 1, 2, 3, ..., null where a node isn't split."""
    nodes = F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "cut", "left", "right"))))
    listed = splits.groupBy("tree").agg(nodes.alias("m"))
    return listed.select("tree", F.array(*[F.element_at("m", F.lit(i)) for i in range(1, size + 1)]).alias("__splits"))


def grow(
    df: DataFrame, row_id: str, label: str, features: Sequence[str], trees: int, depth: int = 3, bins: int = 32,
    tried: int | None = None, least: int = 1, seed: int = 17,
) -> tuple[DataFrame, list[list[float]]]:
    """Splits of ``trees`` trees (numbered from 0) and the cut points of the features.

    Splits: tree, node (1 is the root, 2n and 2n + 1 the children of n), feature
    (its number), cut (rows of a bin up to it go left), gain (decrease of the
    squared error), left and right (mean label of the children). Rows with a null
    in the label or a feature are left out. Children have ``least`` draws at least.
    """
    if depth < 1 or trees < 1:
        raise ValueError("at least one tree of one level")
    tried = tried or max(1, len(features) // 3)
    whole = df.dropna(subset=[label, *features])
    cuts = cut_points(whole, features, bins)
    binned = F.array(*[
        sum(((F.col(c).cast("double") > q).cast("int") for q in points), F.lit(0)) for c, points in zip(features, cuts)
    ])
    rows = settle(whole.select(F.col(row_id).alias("__row"), F.col(label).cast("double").alias("__y"), binned.alias("__bins")))
    dealt = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    dealt = dealt.withColumn("w", drawn(seed, F.col("__row"), F.col("tree"))).filter(F.col("w") > 0)
    splits = None
    for level in range(depth):
        placed = dealt
        node: Column = F.lit(1)
        if splits is not None:
            placed = placed.join(F.broadcast(_arrays(splits, 2**level - 1)), "tree")
            for _ in range(level):
                node = _side(node)
        placed = placed.select("tree", node.alias("node"), "w", "__y", F.posexplode("__bins").alias("feature", "bin")).filter("node is not null")
        cells = placed.groupBy("tree", "node", "feature", "bin").agg(
            F.sum("w").alias("n"), F.sum(F.col("w") * F.col("__y")).alias("s")
        )
        found = settle(_best(cells, tried, least, seed))
        splits = found if splits is None else splits.unionByName(found)
    return settle(splits), cuts


def _best(cells: DataFrame, tried: int, least: int, seed: int) -> DataFrame:
    """The best split of every node from its sums by feature and bin; a window holds the bins of one feature of one node."""
    inside = Window.partitionBy("tree", "node", "feature")
    upto = inside.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("*", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"), F.sum("n").over(inside).alias("na"), F.sum("s").over(inside).alias("sa"))
    sums = sums.withColumn("nr", F.col("na") - F.col("nl")).withColumn("sr", F.col("sa") - F.col("sl"))
    gain = F.try_divide(F.col("sl") * F.col("sl"), F.col("nl")) + F.try_divide(F.col("sr") * F.col("sr"), F.col("nr")) - F.col("sa") * F.col("sa") / F.col("na")
    lot = F.row_number().over(Window.partitionBy("tree", "node").orderBy(_unit(F.lit(seed + 1), "tree", "node", "feature"), "feature"))
    chosen = cells.select("tree", "node", "feature").distinct().withColumn("lot", lot).filter(F.col("lot") <= tried).drop("lot")
    open_ = sums.filter((F.col("nl") >= least) & (F.col("nr") >= least)).withColumn("gain", gain)
    # Gains are compared at ten digits, so that the order of summation decides no tie.
    size = F.floor(F.log10(F.greatest(F.col("gain"), F.lit(1e-300)))).cast("int")
    key = F.struct(F.round(F.col("gain") / F.pow(F.lit(10.0), size), 9).alias("m"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    ranked = open_.filter(F.col("gain") > 1e-12 * F.abs(F.col("sa") * F.col("sa") / F.col("na")) + 1e-12)
    best = ranked.join(chosen, ["tree", "node", "feature"]).groupBy("tree", "node").agg(
        F.max_by(
            F.struct(F.col("feature"), F.col("bin").alias("cut"), F.col("gain"), (F.col("sl") / F.col("nl")).alias("left"), (F.col("sr") / F.col("nr")).alias("right")),
            F.struct(size.alias("size"), key),
        ).alias("b")
    )
    return best.select("tree", "node", "b.*")


def predict(df: DataFrame, row_id: str, features: Sequence[str], splits: DataFrame, cuts: Sequence[Sequence[float]], depth: int, per_forest: int) -> DataFrame:
    """(seed, row_id, p): mean over a forest's trees, forest s holding the trees from s * per_forest on."""
    binned = F.array(*[sum(((F.col(c).cast("double") > q).cast("int") for q in points), F.lit(0)) for c, points in zip(features, cuts)])
    rows = df.dropna(subset=list(features)).select(F.col(row_id).alias("__row"), binned.alias("__bins"))
    trees = _arrays(splits, 2**depth - 1)
    # every row meets every tree: the trees' number is a parameter, and their arrays are broadcast in one row a forest
    forests = trees.groupBy(F.expr(f"tree div {per_forest}").cast("int").alias("seed")).agg(F.collect_list("__splits").alias("__trees"))
    listed = forests.agg(F.collect_list(F.struct("seed", "__trees")).alias("f")).scalar()
    rows = rows.withColumn("__f", F.explode(listed)).select("__row", "__bins", F.col("__f.seed").alias("seed"), F.explode("__f.__trees").alias("__splits"))
    node: Column = F.lit(1)
    value: Column = F.lit(None).cast("double")
    for _ in range(depth):
        split = F.get("__splits", node - 1)
        right = F.get("__bins", split["feature"]) > split["cut"]
        value = F.coalesce(F.when(right, split["right"]).otherwise(split["left"]), value)
        node = _side(node)
    return rows.select("seed", F.col("__row").alias(row_id), value.alias("p")).groupBy("seed", row_id).agg(F.avg("p").alias("p"))


def importances(splits: DataFrame, features: Sequence[str], per_forest: int) -> DataFrame:
    """(seed, feature, importance): shares of the decrease of squared error, averaged over trees, then made to sum to 1."""
    gains = splits.groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
    whole = gains.groupBy("tree").agg(F.sum("g").alias("t"))
    shares = gains.join(whole, "tree").groupBy(F.expr(f"tree div {per_forest}").cast("int").alias("seed"), "feature").agg(F.sum(F.col("g") / F.col("t")).alias("s"))
    every = shares.groupBy("seed").agg(F.sum("s").alias("w"), F.map_from_entries(F.collect_list(F.struct("feature", "s"))).alias("m"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.coalesce(F.element_at("m", F.lit(i)), F.lit(0.0)) / F.col("w")).alias("importance")) for i, c in enumerate(features)])
    return every.select("seed", F.inline(cells))


def repeated_forests(
    df: DataFrame, row_id: str, features: Sequence[str], label: str, repeats: int = 1000, trees: int = 10, depth: int = 3, bins: int = 32, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """Forests of ``repeats`` seeds at once: mean importance of every feature, and the five numbers of the in-sample rho."""
    rows = settle(df.dropna(subset=[label, *features]))  # read for cuts, growth, prediction and labels
    splits, cuts = grow(rows, row_id, label, features, repeats * trees, depth, bins, seed=seed)
    weights = importances(splits, features, trees).groupBy("feature").agg(F.avg("importance").alias("importance"))
    guesses = predict(rows, row_id, features, splits, cuts, depth, trees).join(rows.select(row_id, F.col(label).cast("double").alias("__y")), row_id)
    rho = evaluate(guesses, "__y", "p", ["spearman"], ["seed"])
    return weights, five_numbers(rho, "spearman")


#: Rows of a task that are summed by distinct bins at once, and the most sums of a level that a task may hold.
ROWS_AT_ONCE, MOST_SUMS = 1 << 18, 1 << 25
#: Draws of 16 random bits.
_DRAWS = np.searchsorted(_POISSON, (np.arange(1 << 16) + 0.5) / (1 << 16), "right").astype(float)
#: Quantiles that a fold's rows are known by while cut points are found.
_FINE = 1024


def drawn_at_once(keys: np.ndarray, four: int) -> np.ndarray:
    """How often rows count in four trees, one a column: 64-bit keys are mixed with the number of the four (splitmix64) and cut into quarters."""
    z = keys + np.uint64((four + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    return z.view(np.uint16).reshape(-1, 4)


def _fold_cuts(rows: DataFrame, folds: Sequence[int], count: int, bins: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Mean and cut points of every feature over each fold's training rows, nulls counting as the mean.

    A fold's rows are summed up by _FINE quantiles; a training set's quantiles are those of its folds' together.
    """
    at = [i / _FINE for i in range(1, _FINE + 1)]
    each = [
        e for i in range(count) for c in [F.col(f"x{i}")]
        for e in (F.count(c).alias(f"n{i}"), F.sum(c).alias(f"s{i}"), F.percentile_approx(c, at, 10 * _FINE).alias(f"q{i}"))
    ]
    own = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *each).collect()  # one row per fold
    means, cuts = np.zeros((len(folds), count)), [[np.zeros(0)] * count for _ in folds]
    for j, k in enumerate(folds):
        train = [r for r in own if r["fold"] != k]
        for i in range(count):
            known = [r for r in train if r[f"n{i}"]]
            n = sum(r[f"n{i}"] for r in known)
            means[j, i] = sum(r[f"s{i}"] for r in known) / n if n else 0.0
            values = np.concatenate([*[r[f"q{i}"] for r in known], [means[j, i]]])
            weights = np.concatenate([*[np.full(_FINE, r[f"n{i}"] / _FINE) for r in known], [sum(r["n"] for r in train) - n]])
            values, weights = values[weights > 0], weights[weights > 0]
            order = np.argsort(values)
            upto = np.cumsum(weights[order])
            if len(upto):
                wanted = np.arange(1, bins) / bins * upto[-1] * (1 - 1e-12)
                cuts[j][i] = np.unique(values[order][np.searchsorted(upto, wanted)])
    return means, cuts


def _by_bins(fine: Sequence[np.ndarray], sizes: Sequence[int]) -> np.ndarray:
    """A number for every row, the same for the same bins."""
    code, size = np.zeros(len(fine[0]), np.int64), 1
    for b, m in zip(fine, sizes):
        if size * m >= 1 << 62:
            code, size = np.unique(code, return_inverse=True)[1].astype(np.int64), len(code)
        code, size = code * m + b, size * m
    return code


def _histograms(
    rows: DataFrame, folds: Sequence[int], means: np.ndarray, cuts: Sequence[Sequence[np.ndarray]], trees: int, level: int, splits: dict[tuple[int, int], tuple[int, int]],
) -> DataFrame:
    """Draws and sums of labels by (tree, node, feature, bin) of one level; ``splits``: (feature, cut) of (tree, node).

    Rows of equal bins are summed first, tree by tree, and only these sums go down the trees.
    """
    count, width = means.shape[1], 1 << level
    bins = 1 + max((len(c) for own in cuts for c in own), default=0)
    # A feature is cut at the points of all folds; a fold's bin follows from that. The last one is for nulls.
    points = [np.unique(np.concatenate([own[i] for own in cuts])) for i in range(count)]
    own_bin = [[np.concatenate([[0], np.searchsorted(own[i], points[i], "right"), [np.searchsorted(own[i], means[j, i])]]) for i in range(count)] for j, own in enumerate(cuts)]
    sizes = [len(p) + 2 for p in points]
    feature = np.full((len(folds) * trees, width), -1)
    cut = np.zeros((len(folds) * trees, width), int)
    for (t, node), (f, c) in splits.items():
        feature[t, node], cut[t, node] = f, c

    def add(found: np.ndarray, keys: np.ndarray, y: np.ndarray, fold: np.ndarray, xs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        fine = [np.where(missing, len(p) + 1, np.searchsorted(p, x)) for p, (x, missing) in zip(points, xs)]
        code = _by_bins(fine, sizes)
        order = np.argsort(code)
        code, keys, y, fold = code[order], keys[order], y[order], fold[order]
        for j, k in enumerate(folds):
            train = np.flatnonzero(fold != k)
            if not len(train):
                continue
            own_code, own_keys, own_y = code[train], keys[train], y[train]
            starts = np.concatenate([[0], np.flatnonzero(own_code[1:] != own_code[:-1]) + 1])
            first = order[train[starts]]
            # equal bins of this fold's own cuts, of which there are fewer
            own = [own_bin[j][i][fine[i][first]] for i in range(count)]
            _, at, cell = np.unique(_by_bins(own, [bins] * count), return_index=True, return_inverse=True)
            own = np.stack(own)[:, at]
            each = np.arange(len(at))
            for t in range(j * trees, (j + 1) * trees):
                if t % 4 == 0 or t == j * trees:
                    random = drawn_at_once(own_keys, t // 4)
                w = _DRAWS[random[:, t % 4]]
                n = np.bincount(cell, np.add.reduceat(w, starts))
                s = np.bincount(cell, np.add.reduceat(w * own_y, starts))
                node = np.ones(len(at), int)  # 0: in a leaf
                for _ in range(level):
                    f = feature[t, node]
                    node = np.where(f >= 0, 2 * node + (own[f, each] > cut[t, node]), 0)
                slot = np.where(node > 0, node - width, width) * bins
                for i in range(count):
                    found[t, i, 0] += np.bincount(slot + own[i], n, (width + 1) * bins)
                    found[t, i, 1] += np.bincount(slot + own[i], s, (width + 1) * bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, n = np.zeros((len(folds) * trees, count, 2, (width + 1) * bins)), [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            xs = [table.column(3 + i) for i in range(count)]
            add(found, table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy(), table.column(2).to_numpy(),
                [(x.fill_null(0.0).to_numpy(), x.is_null().to_numpy()) for x in xs])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= ROWS_AT_ONCE:
                flush()
                n = 0
        if held:
            flush()
        found = found[..., : width * bins]
        t, i, at = np.nonzero(found[:, :, 0])
        columns = [t, at // bins + width, i, at % bins]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c.astype(np.int32)) for c in columns], pa.array(found[t, i, 0, at]), pa.array(found[t, i, 1, at])],
            names=["tree", "node", "feature", "bin", "n", "s"],
        )

    sums = rows.mapInArrow(run, "tree int, node int, feature int, bin int, n double, s double")
    return sums.groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def fold_importances(
    df: DataFrame, fold: str, folds: Sequence[int], row_id: str, label: str, features: Sequence[str], trees: int = 10, depth: int = 5,
    bins: int = 32, tried: int | None = None, least: int = 1, seed: int = 17,
) -> DataFrame:
    """``(fold, feature, weight)``: importances of a regression forest fitted on ``fold <> k`` for every fold k.

    The usual preparation is included: nulls become the training mean, and scaling
    changes no split. All forests grow together, one pass over the rows a level;
    folds x trees x 2^depth splits at most reach the driver.
    """
    if depth < 1 or trees < 1:
        raise ValueError("at least one tree of one level")
    folds, tried = list(folds), tried or max(1, len(features) // 3)
    if 2 * len(folds) * trees * len(features) * bins << depth - 1 > MOST_SUMS:
        raise ValueError("too many trees, levels or features for sums in tasks; cross_validate fits such forests one by one")
    known = df.filter(F.col(label).isNotNull() & F.col(fold).isNotNull())
    rows = settle(known.select(
        F.xxhash64(F.lit(seed), F.col(row_id)).alias("key"), F.col(label).cast("double").alias("y"), F.col(fold).alias("fold"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
    ))
    means, cuts = _fold_cuts(rows, folds, len(features), bins)
    splits: list[tuple] = []
    for level in range(depth):
        known_splits = {(r["tree"], r["node"]): (r["feature"], r["cut"]) for r in splits}
        cells = _histograms(rows, folds, means, cuts, trees, level, known_splits).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = _best(cells, tried, least, seed).collect()
        finally:
            cells.unpersist()
        splits += found
        if not found:
            break
    gain = np.zeros((len(folds) * trees, len(features)))
    for r in splits:
        gain[r["tree"], r["feature"]] += r["gain"]
    whole = gain.sum(axis=1, keepdims=True)
    # Every tree counts alike; a tree without a split counts nowhere.
    share = np.divide(gain, whole, out=np.zeros_like(gain), where=whole > 0).reshape(len(folds), trees, -1).sum(axis=1)
    total = share.sum(axis=1, keepdims=True)
    weight = np.divide(share, total, out=np.zeros_like(share), where=total > 0)
    table = [(k, c, float(weight[j, i])) for j, k in enumerate(folds) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(table, "fold int, feature string, weight double")
