"""Multinomial naive Bayes of word counts, kept as tables.

Counts of (word, fold) by class are summed once. The training counts of a fold are
the totals without its own, so every fold's model is a difference, and nothing of
the vocabulary's size ever leaves the tables. Scoring looks up a row's words in
them, frequent words apart from the rest, and sums up per row.

Words that a fold's training rows lack are left out of its scores. Smoothing adds
``smoothing`` to each word count and class size. Of equally likely classes the
first wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.rank import attach
from cohortline.operators.running import settle, spread
from cohortline.operators.text import look_up_counts


def _by_class(label: str, classes: Sequence, value: Column) -> Column:
    return F.array(*[F.coalesce(F.sum(F.when(F.col(label) == c, value)), F.lit(0)) for c in classes])


def _less(a: str, b: Column, n: int) -> Column:
    return F.array(*[F.get(a, F.lit(i)) - F.coalesce(F.get(b, F.lit(i)), F.lit(0)) for i in range(n)])


def word_table(terms: DataFrame, fold: str, label: str, classes: Sequence) -> DataFrame:
    """``word``, ``c`` (its count), ``total`` by class, and ``own``: its counts by class for each fold it occurs in."""
    cells = terms.groupBy("word", fold).agg(_by_class(label, classes, F.col("tf")).alias("n"))
    sums = [F.sum(F.get("n", F.lit(i))) for i in range(len(classes))]
    return cells.groupBy("word").agg(
        F.array(*sums).alias("total"), sum(sums[1:], sums[0]).alias("c"), F.map_from_entries(F.collect_list(F.struct(fold, "n"))).alias("own")
    )


def fold_table(df: DataFrame, table: DataFrame, fold: str, label: str, classes: Sequence, smoothing: float) -> DataFrame:
    """One row per fold: log priors of the classes and the logarithms of their smoothed word totals, without the fold's rows."""
    n = len(classes)
    rows = df.groupBy(fold).agg(_by_class(label, classes, F.lit(1)).alias("r"))
    tokens = table.select(F.explode("own").alias("f", "n"), F.size("own").alias("folds")).groupBy("f").agg(
        F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(n)]).alias("w"), F.count(F.when(F.col("folds") == 1, 1)).alias("only")
    )
    whole = table.agg(F.array(*[F.coalesce(F.sum(F.get("total", F.lit(i))), F.lit(0)) for i in range(n)]).alias("w"), F.count(F.lit(1)).alias("v"))
    all_rows = rows.agg(F.array(*[F.sum(F.get("r", F.lit(i))) for i in range(n)]).alias("r")).scalar()
    joined = rows.join(tokens, F.col(fold) == F.col("f"), "left")
    joined = joined.withColumns({"__r": all_rows, "__w": whole.select("w").scalar(), "__v": whole.select("v").scalar()})
    train = _less("__r", F.col("r"), n)
    used = _less("__w", F.coalesce("w", F.array(*[F.lit(0).cast("long")] * n)), n)
    vocabulary = F.col("__v") - F.coalesce("only", F.lit(0))
    every = F.aggregate(train, F.lit(0).cast("long"), lambda a, x: a + x)
    return joined.select(
        F.col(fold),
        F.transform(train, lambda x: F.log(x + smoothing) - F.log(every + smoothing * n)).alias("prior"),
        F.transform(used, lambda x: F.log(x + smoothing * vocabulary)).alias("size"),
    )


def out_of_fold(
    df: DataFrame, row_id: str, label: str, words: str, fold: str, classes: Sequence, smoothing: float = 1.0
) -> DataFrame:
    """``row_id``, fold, label, ``scores`` (log joint probability by class) and ``Predicted_value`` of every labelled row.

    ``words`` is an array of words; ``row_id`` is unique.
    """
    n = len(classes)
    known = df.filter(F.col(label).isin(*classes)).select(row_id, label, fold, words)
    found = spread(known).select(row_id, label, fold, F.explode(words).alias("word"))
    terms = settle(found.groupBy(row_id, label, fold, "word").agg(F.count(F.lit(1)).alias("tf")))
    table = settle(word_table(terms, fold, label, classes))
    folds = fold_table(known, table, fold, label, classes, smoothing)
    looked = look_up_counts(terms.select(row_id, fold, "word", "tf"), table, "word", "c", table.agg(F.sum("c").alias("t")).scalar())
    own = F.element_at("own", F.col(fold))
    looked = looked.withColumn("__n", _less("total", own, n)).filter(F.exists("__n", lambda x: x > 0))
    parts = looked.groupBy(row_id).agg(
        *[F.sum(F.col("tf") * F.log(F.get("__n", F.lit(i)) + smoothing)).alias(f"__s{i}") for i in range(n)], F.sum("tf").alias("__t")
    )
    joined = attach(known.select(row_id, label, fold), parts, [row_id], "left")
    joined = joined.join(F.broadcast(folds), fold)  # one row per fold
    none = F.lit(0.0)
    scores = F.array(*[
        F.get("prior", F.lit(i)) + F.coalesce(F.col(f"__s{i}") - F.col("__t") * F.get("size", F.lit(i)), none) for i in range(n)
    ])
    values = F.array(*[F.lit(c) for c in classes])
    best = F.get(values, (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    return joined.select(row_id, fold, label, scores.alias("scores")).withColumn("Predicted_value", best)
