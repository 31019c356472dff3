"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a longest stretch of words with smallest period q that is at least
``shortest`` words and ``repeats`` periods long. Each word of a run occurs at
least ``repeats`` times in it. So a word that occurs more rarely within a segment
is in none of its runs and splits it; the parts are counted and split anew until
no word is too rare, or a part is too short for a run. Most texts end here.

In a segment that is left, the lag of a position is the distance to the next
place where the ``g`` words from there on recur. Where g is at least the period q,
and the run has g + q words (so runs have three periods at least), the lags from
its first word on are q, up to g + q - 1 words before its end, and not beyond: a
run is one stretch of equal lags. Gram lengths double (periods up to 16, 32, 64, ...), with exact
gram numbers by ranking pairs, so a segment of m words takes m log^2 m steps,
and the scan stops as soon as no gram recurs.

Rows: null, empty and blank texts have no words, no runs and an empty collapsed
text. Ties and repeated rows are judged one by one. An empty table gives an empty
result. Added columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.common import text_batches

SHORTEST, REPEATS = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
WORD = r"[^\x20\x09-\x0D]+"


def segments(ids: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Ends (first, behind the last) of the stretches in which every word occurs ``repeats`` times."""
    todo, done = [(0, len(ids))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo < shortest:
            continue
        if hi - lo == len(ids):
            often = np.bincount(ids)[ids] >= repeats
        else:
            _, at, count = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
            often = count[at] >= repeats
        if often.all():
            done.append((lo, hi))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).view(np.int8)))
        todo.extend((lo + a, lo + b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= shortest)
    return sorted(done)


def _paired(gram: np.ndarray, step: int) -> np.ndarray:
    """Numbers of the grams twice as long."""
    whole = gram[:-step].astype(np.int64) * (int(gram.max()) + 1) + gram[step:]
    return np.unique(whole, return_inverse=True)[1]


def _lags(gram: np.ndarray) -> np.ndarray | None:
    """Distance to the next equal gram (0: none); None if no gram recurs."""
    order = np.argsort(gram, kind="stable")
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    if not len(same):
        return None
    out = np.zeros(len(gram), np.int64)
    out[order[same]] = order[same + 1] - order[same]
    return out


def scan(ids: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment."""
    gram, size, first, out = np.unique(ids, return_inverse=True)[1], 1, True, []
    while len(gram) > size and 3 * size <= shortest:
        gram, size = _paired(gram, size), 2 * size
    while size // 2 < len(ids) // repeats or first:
        lags = _lags(gram)
        if lags is None:
            break
        low = 0 if first else size // 2
        lags[(lags <= low) | (lags > size)] = 0
        ends = np.flatnonzero(np.diff(np.concatenate(([-1], lags, [-1]))))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            q = int(lags[a])
            length = b - a + size - 1 + q
            if q and length >= max(shortest, repeats * q):
                out.append((a, length, q))
        if len(gram) <= size:
            break
        gram, size, first = _paired(gram, size), 2 * size, False
    return out


def runs_of(words: list, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """Runs of a text by start, then period."""
    if len(words) < shortest:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return sorted(
        ((lo + s, n, q) for lo, hi in segments(ids, shortest, repeats) for s, n, q in scan(ids[lo:hi], shortest, repeats)),
        key=lambda r: (r[0], r[2]),
    )


def kept(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    stay = np.ones(len(words), bool)
    for s, n, q in runs:
        stay[s + q : s + n] = False
    return [words[i] for i in np.flatnonzero(stay)]


def find(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """Add to each row ``runs`` (array of start, length, period) and ``collapsed``, the text with one period of each run."""
    if repeats < 3 or shortest < 2:
        raise ValueError("a run has at least three periods and two words")
    text_batches(docs.sparkSession)
    plain = docs.drop("runs", "collapsed") if text not in ("runs", "collapsed") else docs
    at, names = plain.columns.index(text), [*plain.columns, "runs", "collapsed"]
    run = "array<struct<start:long,length:long,period:long>>"
    schema = T.StructType([*plain.schema.fields, T.StructField("runs", T._parse_datatype_string(run)), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, left = [], []
            for t in b.column(at).to_pylist():
                words = (t or "").encode("utf-8", "replace").split()
                found.append(runs_of(words, shortest, repeats))
                left.append(b" ".join(kept(words, found[-1])).decode())
            flat = [r for f in found for r in f]
            fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(left, pa.string())], names=names)

    return plain.mapInArrow(work, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by crc32 of its id) repeats its words from a place on with some period."""
    words, n = F.col("words"), F.size("words")
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    split = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    changed = (F.col("h") % 10 == 0) & F.col("text").rlike(WORD)
    split = split.withColumn("words", F.when(changed, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    split = split.withColumn("g", F.expr("h div 10")).withColumn("n", n).withColumn("a", F.expr("int(g % n)"))
    split = split.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), int((n - a) div p + 1))), 1, n - a)")
    tiled = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a")), again), " ")
    return split.select("doc_id", F.when(words.isNotNull(), tiled).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of a found table: best run, all runs and the collapsed text as sha256."""

    def line(r: Column) -> Column:
        return F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))

    def better(a: Column, b: Column) -> Column:
        # a stays unless b's length / period is larger; runs come by start, then period
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col("__best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * __best.length div __best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
