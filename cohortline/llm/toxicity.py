"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its hashed character n-grams (and of the
whole word), a text is the mean of its words and of a few empty ones (``padding``,
so that two words don't decide alone), and a two-class softmax reads the text's
vector. Embeddings and softmax are trained jointly, in numpy, on a sample
of labelled rows. Misspelt and unseen words share the n-grams of known ones.

Fixed by parameters, whatever the size of the tables: the number of sampled rows
(``sample_rows``, half of it for each class as far as there are so many) and the
number of n-gram buckets. A sampled text is kept as the shares of its buckets, so
its length doesn't matter beyond their number. One task trains on the sample and
returns a weight per bucket; nothing else of the model or the texts reaches the
driver. Everything else covers all rows: class totals (which undo the sample's
balance) and scores.

As the softmax is linear in the mean, a word adds one number to a text's log
odds, so workers keep numbers of words, and broadcast weights are one per bucket.

Rows: a null or blank text has no words and gets the score of the intercept. A
null label or doc_id teaches nothing; a doc_id labelled twice counts as toxic if
any of its labels says so. Without labels of both classes every score is the
share of toxic labels (0 without labels). Equal rows get equal scores, each in a
row of its own. Extra columns pass through ``score``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.common import text_batches

SAMPLE_ROWS = 8000
THRESHOLD = 0.3
REMEMBERED = 1_000_000
_EDGES = b"\"'()[]{}<>.,;:!?*#$%&+-=_/\\|~^`@"


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 17
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    padding: int = 10
    epochs: int = 12
    rate: float = 0.5
    batch: int = 32
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Log odds of a text: ``intercept`` plus the (padded) mean over its words of the mean bucket weight."""

    shape: Shape
    weights: np.ndarray
    intercept: float


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's digits leaves 2 when divided by 4. Null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def subwords(word: bytes, shape: Shape) -> list[int]:
    """Buckets of the whole word and of its n-grams between word marks; n-grams don't cut characters."""
    core = word.strip(_EDGES) or word
    marked = "<" + core.decode("utf-8", "replace") + ">"
    found = [zlib.crc32(core) % shape.buckets]
    for n in range(shape.shortest, shape.longest + 1):
        for i in range(len(marked) - n + 1):
            found.append(zlib.crc32(marked[i : i + n].encode(), n) % shape.buckets)
    return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _bag(text: str | None, known: dict, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares of its mean; never more entries than buckets."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    parts = []
    for w in words:
        ids = known.get(w)
        if ids is None:
            if len(known) > REMEMBERED:
                known.clear()
            ids = known[w] = np.array(subwords(w, shape), np.int32)
        parts.append(ids)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    share = np.bincount(np.concatenate(parts), np.repeat(1 / (sizes * (len(parts) + shape.padding)), sizes), shape.buckets)
    ids = np.flatnonzero(share)
    return ids.astype(np.int32), share[ids].astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], shape: Shape, share_toxic: float) -> Model:
    """Joint gradient steps (with per-row scaling) on embeddings and softmax.

    Both classes weigh alike in training; the intercept then returns to the share of toxic labels.
    """
    rng = np.random.default_rng(shape.seed)
    y = np.array([b[2] for b in bags], np.float64)
    if len(bags) == 0 or y.min() == y.max():
        p = min(max(share_toxic, 1e-9), 1 - 1e-9)
        return Model(shape, np.zeros(shape.buckets, np.float32), float(np.log(p / (1 - p))))
    table = rng.uniform(-1, 1, (shape.buckets, shape.dim)).astype(np.float32) / shape.dim
    soft = rng.normal(0, 0.3, (2, shape.dim)).astype(np.float32)
    bias = np.zeros(2)
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    seen = np.full(shape.buckets, 1e-6, np.float32)
    seen_soft, seen_bias = np.full((2, shape.dim), 1e-6), np.full(2, 1e-6)
    for _ in range(shape.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), shape.batch):
            some = order[at : at + shape.batch]
            sizes = np.array([len(bags[i][0]) for i in some])
            ids = np.concatenate([bags[i][0] for i in some])
            share = np.concatenate([bags[i][1] for i in some])
            text = np.repeat(np.arange(len(some)), sizes)
            mean = np.stack([
                share[a : a + n] @ table[ids[a : a + n]] if n else np.zeros(shape.dim, np.float32)
                for a, n in zip(np.cumsum(sizes) - sizes, sizes)
            ])
            raw = mean @ soft.T + bias
            p = np.exp(raw - raw.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = p.copy()
            wrong[np.arange(len(some)), y[some].astype(int)] -= 1
            wrong *= weigh[some][:, None] / len(some)
            pull = np.bincount(ids, share * wrong[text, 1], shape.buckets).astype(np.float32)
            touched = np.flatnonzero(pull)
            across = (soft[1] - soft[0]).astype(np.float32)
            grad_soft, grad_bias = wrong.T @ mean, wrong.sum(0)
            seen[touched] += pull[touched] ** 2 * float(across @ across) / shape.dim
            table[touched] -= (shape.rate * pull[touched] / np.sqrt(seen[touched]))[:, None] * across
            seen_soft += grad_soft**2
            soft -= (shape.rate * grad_soft / np.sqrt(seen_soft)).astype(np.float32)
            seen_bias += grad_bias**2
            bias -= shape.rate * grad_bias / np.sqrt(seen_bias)
    p = min(max(share_toxic, 1e-9), 1 - 1e-9)
    shift = np.log(p / (1 - p))
    return Model(shape, table @ (soft[1] - soft[0]), float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows that aren't held out; the sample is the same on every run."""
    spark = docs.sparkSession
    text_batches(spark)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = {int(r[0]): int(r[1]) for r in known.groupBy("toxic").count().collect()}
    share_toxic = total.get(1, 0) / max(1, sum(total.values()))
    few = [min(total.get(c, 0), sample_rows // 2) for c in (0, 1)]
    room = [sample_rows - few[1], sample_rows - few[0]]
    chosen = [
        (int(r[0]), c)
        for c in (0, 1)
        for r in known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(room[c]).select("doc_id").collect()
    ]
    sampled = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))  # sample_rows rows at most
    # An id that many rows have teaches once: of its texts the one of the smallest digest.
    once = texts.join(sampled, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, np.ndarray] = {}
        for b in batches:
            made = [_bag(t, memo, shape) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([x.tobytes() for x, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())],
                names=["doc_id", "toxic", "ids", "shares"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [
            (doc, (ids.view(np.int32), shares.view(np.float32), toxic))
            for b in batches
            for doc, toxic, ids, shares in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _in_place(b.column(2)), _in_place(b.column(3)))
        ]
        made.sort(key=lambda x: x[0])
        m = train([x for _, x in made], shape, share_toxic)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype("<f4").tobytes()], pa.binary()), pa.array([m.intercept])], names=["weights", "intercept"])

    made = once.select("doc_id", "text", "toxic").mapInArrow(bags, "doc_id long, toxic int, ids binary, shares binary")
    learned = made.repartition(1).mapInArrow(learn, "weights binary, intercept double").first()  # the sample in one task
    if learned is None:
        return train([], shape, share_toxic)
    return Model(shape, np.frombuffer(learned["weights"], "<f4"), learned["intercept"])


def _in_place(column: pa.Array) -> list[np.ndarray]:
    """The values of a binary column as bytes in the column's own memory."""
    return [np.frombuffer(v.as_buffer(), np.uint8) for v in column]


class _Worth(dict):
    """Log-odds share of each word, worked out once per worker."""

    def __init__(self, weights: np.ndarray, shape: Shape):
        super().__init__()
        self.weights, self.shape = weights, shape

    def __missing__(self, word: bytes) -> float:
        out = self[word] = float(self.weights[subwords(word, self.shape)].mean())
        return out


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of label 1 (double) to each row, from its whole text and nothing else."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model.weights)  # one float per bucket; an array, as executors may lack this package
    shape, intercept = model.shape, model.intercept
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != name], T.StructField(name, T.DoubleType())])
    plain = docs.drop(name)
    at, names = plain.columns.index(text), [*plain.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = _Worth(shared.value, shape)
        for b in batches:
            raw = np.empty(b.num_rows)
            for i, t in enumerate(b.column(at).to_pylist()):
                words = words_of(t)
                raw[i] = intercept + sum(map(worth.__getitem__, words)) / max(1, len(words) + shape.padding)
            if len(worth) > REMEMBERED:
                worth.clear()
            p = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=names)

    return plain.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels, **fitting)
    narrow = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(narrow, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def reject(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows that are not predicted toxic, with their own columns."""
    model = fit(docs, labels, **fitting)
    return score(docs, model, name="__toxic").filter(F.col("__toxic") < THRESHOLD).select(*docs.columns)
