"""Models on a tree of labels.

Each node has a label and, below the root, asks its parent's label to have a
value: only such rows train it. Every row is scored by every node (with the model
of its own fold), and a node's probability is carried up the tree: at each
ancestor with probability n, c becomes c * n + (1 - c) * n / 2.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.ensemble import up_the_tree
from cohortline.operators.models import make_estimator, preparation
from cohortline.operators.moments import fit_blocks, gather, layout, predicted


@dataclass(frozen=True)
class Node:
    """A model of P(``label`` = ``positive``); rows train it where the parent node's label is ``value`` (case ignored)."""

    name: str
    label: str
    positive: str
    parent: str | None = None
    value: str | None = None


def line(nodes: Sequence[Node], name: str) -> list[Node]:
    """The ancestors of a node, the nearest first."""
    by_name, out = {n.name: n for n in nodes}, []
    node = by_name[name]
    while node.parent is not None:
        if node.parent not in by_name:
            raise KeyError(f"{node.name!r} has an unknown parent {node.parent!r}")
        node = by_name[node.parent]
        if node in out:
            raise ValueError(f"{name!r} is its own ancestor")
        out.append(node)
    return out


def trains(nodes: Sequence[Node], node: Node) -> Column:
    """Rows that train a node: its own label is known, and every ancestor's label has the value that leads here."""
    keep, at = F.col(node.label).isNotNull(), node
    for above in line(nodes, node.name):
        keep = keep & F.coalesce(F.lower(F.col(above.label).cast("string")) == str(at.value).lower(), F.lit(False))
        at = above
    return keep


def target(node: Node) -> Column:
    return (F.lower(F.col(node.label).cast("string")) == node.positive.lower()).cast("double")


def least_squares(features: Sequence[str]) -> Callable:
    """Scores by a linear fit of the 0/1 target, cut to 0..1; all folds from one pass of sums."""

    def score(train: DataFrame, rows: DataFrame, fold: str, folds: Sequence[int], label: str, out: str) -> DataFrame:
        shape = layout(train, features, label)
        place = F.lit(None).cast("int")
        for i, k in enumerate(folds):
            place = F.when(F.col(fold) == k, i).otherwise(place)
        stats = gather(train.filter(place.isNotNull()), label, shape, F.array(place))
        wanted = [(k, 0, j, "test" if i == j else "train") for i, k in enumerate(folds) for j in range(len(folds))]
        sets = train.sparkSession.createDataFrame(wanted, "outer int, inner int, block int, use string")
        fits = fit_blocks(stats, sets, shape, [(0.0, 0.0)]).select(F.col("outer").alias("__outer"), "intercept", "slopes", "fills")
        joined = rows.join(F.broadcast(fits), F.col(fold) == F.col("__outer"), "left")  # one fit per fold
        return joined.select(*rows.columns, F.least(F.greatest(predicted(features), F.lit(0.0)), F.lit(1.0)).alias(out))

    return score


def classifier(model: str, features: Sequence[str], params: Mapping[str, object] | None = None) -> Callable:
    """Scores by a named probabilistic classifier, one fit per fold."""

    def score(train: DataFrame, rows: DataFrame, fold: str, folds: Sequence[int], label: str, out: str) -> DataFrame:
        every = None
        for k in folds:
            stages = [*preparation(features), make_estimator(model, label, params)]
            fitted = Pipeline(stages=stages).fit(train.filter(F.col(fold) != k))
            own = rows.filter(F.col(fold) == k).withColumns({f"__{c}": F.col(c) for c in features})
            scored = fitted.transform(own)
            part = scored.select(
                *[F.col(f"__{c}").alias(c) if c in features else F.col(c) for c in rows.columns],
                F.get(vector_to_array("probability"), F.lit(1)).alias(out),
            )
            every = part if every is None else every.unionByName(part)
        return every

    return score


def fit_tree(
    df: DataFrame, nodes: Sequence[Node], fold: str, folds: Sequence[int], scorer: Callable, hard: bool = False
) -> DataFrame:
    """``df`` with, for each node, ``<name>_own`` (out-of-fold P of its own model) and ``<name>`` (carried up the tree).

    ``scorer`` comes from ``least_squares`` or ``classifier``. ``hard`` rounds the
    ancestors' probabilities first, half to even.
    """
    out = df
    for node in nodes:
        labelled = df.filter(trains(nodes, node)).withColumn("__target", target(node))
        out = scorer(labelled, out, fold, list(folds), "__target", f"{node.name}_own")
    cells = {
        node.name: up_the_tree(F.col(f"{node.name}_own"), [F.col(f"{a.name}_own") for a in line(nodes, node.name)], hard, half_even=True)
        for node in nodes
    }
    return out.withColumns(cells)
