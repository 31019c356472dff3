"""Approximate nearest neighbours by cosine: NN-descent for the graph, greedy search for queries.

1. Equal vectors become one node with the smallest ids that carry it, so copies
   cost nothing and don't fill each other's neighbour lists.
2. Nodes start with the best of a few random groups (the cells of random
   hyperplanes through sample medians; larger cells are split by hash).
3. NN-descent: each node gathers its neighbours and a sample of the nodes that
   have it as a neighbour, all pairs in this small group are compared, and pairs
   better than a node's worst neighbour go to that node. Joins and groupings do
   the gathering; groups have a size bound, hub nodes included.
4. Search: each query keeps its ``beam`` best nodes, opens the best unopened ones,
   joins them to the graph and merges what it finds, until none is unopened. It
   begins at its own node, if it is in the graph, and at a few fixed entry nodes.
5. The best of the beam, and all that rounding could put among the nearest, are
   scored anew, in double precision on the original vectors; equal scores go to
   the smaller id. The beam is wider than ``beam`` where more nodes tie so.

Graph and search compare unit vectors in four bytes a component. Every row is indexed.

Rows: vectors that are null, zero, of a length other than the most frequent one,
or hold null or non-finite components take no part, nor do null ids. Repeated
rows with one id count once. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import settle, text_batches


@dataclass(frozen=True)
class Shape:
    degree: int = 24
    reverse: int = 24
    starts: int = 4
    rounds: int = 5
    cell: int = 64
    offered: int = 10
    beam: int = 512
    opened: int = 64
    entries: int = 64
    rescored: int = 32
    sample: int = 5000
    seed: int = 11


#: Frontiers (query, node, 256 bytes at 64 dimensions) of at most so many rows may be broadcast to the graph; larger ones are joined by shuffle.
BROADCAST_FRONTIER = 125_000
_PAIR = pa.list_(pa.struct([("score", pa.float32()), ("node", pa.int64())]))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0][0] if sizes else 0))


def _packed(v: np.ndarray) -> list[bytes]:
    """Unit vectors as floats."""
    v = v / np.abs(v).max(1, keepdims=True)  # first, so that squares neither overflow nor vanish
    v = v / np.sqrt((v * v).sum(1, keepdims=True))
    return [x.tobytes() for x in v.astype(np.float32)]


def _floats(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float32).reshape(len(packed), -1)


def _margin(dims: int) -> float:
    """By how much the rounding of two scores (components, products, sums, result) may misplace them at most."""
    return (dims + 4) * 2.0**-23


def nodes(rows: DataFrame, kept: int) -> DataFrame:
    """node (smallest id), ids (the ``kept`` smallest), v, q (packed) of each distinct vector."""
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.hash("v"), "part": F.spark_partition_id()})
    # Ids are cut to the smallest where they were read, so a vector may own any share of the rows.
    few = keyed.groupBy("k1", "k2", "part").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, kept).alias("ids"), F.first("v").alias("v"))
    one = few.groupBy("k1", "k2").agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, kept).alias("ids"), F.first("v").alias("v")
    ).select(F.get("ids", F.lit(0)).alias("node"), "ids", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = _packed(np.array(b.column(2).to_pylist(), np.float64)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed, pa.binary())], names=["node", "ids", "v", "q"])

    return one.mapInArrow(run, "node long, ids array<long>, v array<double>, q binary")


def _compared(groups: DataFrame, shape: Shape) -> DataFrame:
    """node, found: what each member of a group (members: node, q, worst) may gain from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, found = [], []
            for members in b.column(0).to_pylist():
                ids = np.array([m["node"] for m in members], np.int64)
                x = _floats([m["q"] for m in members])
                s = x @ x.T
                s[ids[:, None] == ids] = -3
                k = min(shape.offered, len(ids) - 1)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                v = np.take_along_axis(s, at, 1)
                better = v > np.array([m["worst"] for m in members], np.float32)[:, None]
                for i in np.flatnonzero(better.any(1)):
                    who.append(ids[i])
                    found.append([{"score": float(p), "node": int(ids[j])} for p, j in zip(v[i][better[i]], at[i][better[i]]) if p > -3])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(found, _PAIR)], names=["node", "found"])

    gathered = groups.groupBy("g").agg(F.collect_list(F.struct("node", "q", "worst")).alias("members"))
    return gathered.filter(F.size("members") > 1).select("members").mapInArrow(run, "node long, found array<struct<score:float,node:long>>")


def _best(pairs: DataFrame, degree: int) -> DataFrame:
    """node, found: each node's best neighbours of all that were found."""
    return pairs.groupBy("node").agg(F.slice(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("found"))), asc=False), 1, degree
    ).alias("found"))


def _worst(degree: int) -> Column:
    return F.when(F.size("found") >= degree, F.element_at("found", -1)["score"]).otherwise(F.lit(-2.0)).cast("float")


def _members(graph: DataFrame, shape: Shape) -> DataFrame:
    """g, node: each node's group, that is itself, its neighbours and about ``reverse`` of those that point to it."""
    out = graph.select(F.col("node").alias("g"), F.explode("found.node").alias("node"))
    pointed = out.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    back = out.join(pointed, "node").filter(
        F.pmod(F.xxhash64("g", "node"), F.lit(1 << 20)) * F.col("n") < F.lit(shape.reverse << 20)
    ).select(F.col("node").alias("g"), F.col("g").alias("node"))
    return out.union(back).union(graph.select("node", "node")).distinct()


def build(indexed: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The neighbour graph of nodes (node, q): node, found (score, node) best first."""
    n = indexed.count()
    light = indexed.select("node", "q")
    graph = settle(light.select("node", F.array().cast("array<struct<score:float,node:bigint>>").alias("found")))
    if n < 2:
        return graph
    rng = np.random.default_rng(shape.seed)
    picked = light.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, shape.sample / n)))).limit(2 * shape.sample)
    sample = _floats([bytes(r[0]) for r in picked.select("q").collect()] or [bytes(light.first()[1])])
    bits = max(0, math.ceil(math.log2(n / shape.cell)))
    for _ in range(shape.starts):
        planes = rng.normal(size=(sample.shape[1], bits)).astype(np.float32)
        middle = np.median(sample @ planes, axis=0)

        def cells(batches: Iterator[pa.RecordBatch], planes=planes, middle=middle) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code = (_floats(b.column(1).to_pylist()) @ planes > middle) @ (1 << np.arange(planes.shape[1], dtype=np.int64)) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.int64())], names=["node", "q", "cell"])

        placed = light.mapInArrow(cells, "node long, q binary, cell long")
        crowd = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        split = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (2 * shape.cell)))
        members = placed.join(crowd, "cell").select(F.xxhash64("cell", split).alias("g"), "node", "q")
        known = members.join(graph, "node").select("g", "node", "q", _worst(shape.degree).alias("worst"))
        graph = settle(_best(graph.union(_compared(known, shape)), shape.degree))
    for _ in range(shape.rounds):
        worst = light.join(graph, "node").select("node", "q", _worst(shape.degree).alias("worst"))
        known = _members(graph, shape).join(worst, "node").select("g", "node", "q", "worst")
        graph = settle(_best(graph.union(_compared(known, shape)), shape.degree))
    return graph


def _near(scores: list[float], kept: int, k: int, margin: float) -> int:
    """How many of the scores, best first, are kept: ``kept``, and all that may belong to the ``k`` best and the query's own node."""
    if len(scores) <= kept:
        return len(scores)
    floor = scores[min(k, len(scores) - 1)] - margin
    while kept < len(scores) and scores[kept] >= floor:
        kept += 1
    return kept


def _opened(shape: Shape, k: int):
    """Merge what was found into each query's beam, name the nodes to open next and how many to score anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("score", pa.float32()), ("node", pa.int64()), ("open", pa.bool_())]))
        for b in batches:
            beams, fronts, again = [], [], []
            for q, entries in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got: dict[int, tuple[float, bool]] = {}
                for e in entries:
                    if e["node"] not in got or e["open"]:
                        got[e["node"]] = (e["score"], e["open"])
                top = sorted(got.items(), key=lambda x: (-x[1][0], x[0]))
                scores, margin = [s for _, (s, _) in top], _margin(len(q) // 4)
                top = top[: _near(scores, shape.beam, k, margin)]
                again.append(min(len(top), _near(scores, shape.rescored, k, margin)))
                front = [i for i, (_, opened) in top if not opened][: shape.opened]
                chosen = set(front)
                beams.append([{"score": s, "node": i, "open": o or i in chosen} for i, (s, o) in top])
                fronts.append(front)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(beams, kind), pa.array(fronts, pa.list_(pa.int64())), pa.array(again, pa.int32())],
                names=["query", "q", "beam", "front", "again"],
            )

    return run


def _looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of a query with all members of an opened node's group."""
    for b in batches:
        out = []
        for q, members in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            s = _floats([m["q"] for m in members]) @ _floats([q])[0]
            out.append([{"score": float(p), "node": m["node"]} for p, m in zip(s, members)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _PAIR)], names=["query", "found"])


def search(queries: DataFrame, indexed: DataFrame, graph: DataFrame, shape: Shape = Shape(), k: int = 5) -> DataFrame:
    """query, node: all nodes of each query's beam that may be among its ``k`` nearest (query: its node or any id; q: packed vector)."""
    wide = _members(graph, shape).join(indexed.select("node", "q"), "node").groupBy("g").agg(F.collect_list(F.struct("node", "q")).alias("members"))
    wide = settle(wide)
    first = indexed.orderBy(F.xxhash64("node"), "node").limit(shape.entries).select("node", "q").collect()
    shown = [(int(r[0]), bytes(r[1])) for r in first]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("score", pa.float32()), ("node", pa.int64()), ("open", pa.bool_())]))
        other = _floats([q for _, q in shown]) if shown else None
        for b in batches:
            rows = []
            for node, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = other @ _floats([q])[0]
                rows.append([{"score": 1.0, "node": node, "open": False}] + [
                    {"score": float(p), "node": i, "open": False} for p, (i, _) in zip(s, shown)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, kind)], names=["query", "q", "entries"])

    entries = "entries array<struct<score:float,node:long,open:boolean>>"
    beam = "beam array<struct<score:float,node:long,open:boolean>>, front array<long>, again int"
    state = queries.select("query", "q").mapInArrow(start, f"query long, q binary, {entries}")
    while True:
        state = settle(state.mapInArrow(_opened(shape, k), f"query long, q binary, {beam}"))
        front = state.select("query", "q", F.explode("front").alias("at"))
        size = state.agg(F.sum(F.size("front"))).first()[0]
        if not size:
            return state.select("query", F.explode(F.slice("beam.node", F.lit(1), F.col("again"))).alias("node"))
        asked = F.broadcast(front) if size <= BROADCAST_FRONTIER else front
        looked = wide.join(asked, F.col("g") == F.col("at")).select("query", "q", "members").mapInArrow(
            _looked, "query long, found array<struct<score:float,node:long>>"
        )
        news = looked.select("query", F.lit(None).cast("binary").alias("q"), F.transform("found", lambda x: F.struct(
            x["score"].alias("score"), x["node"].alias("node"), F.lit(False).alias("open"))).alias("entries"))
        state = state.select("query", "q", F.col("beam").alias("entries")).union(news).groupBy("query").agg(
            F.max("q").alias("q"), F.flatten(F.collect_list("entries")).alias("entries")
        )


def cosine(a: Column, b: Column) -> Column:
    """In double precision, on the vectors as they are."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y)
    norm = lambda x: F.sqrt(total(F.transform(x, lambda y: y * y)))
    return total(F.zip_with(a, b, lambda x, y: x * y)) / (norm(a) * norm(b))


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, shape: Shape = Shape()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each row whose id is divisible by ``every``."""
    text_batches(vectors.sparkSession)
    rows = usable(vectors)
    indexed = settle(nodes(rows, k + 1))
    graph = build(indexed, shape)
    asking = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("k1"), F.hash("v").alias("k2")).distinct()
    keyed = indexed.select("node", "q", "v", F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"))
    asking = settle(asking.join(keyed, ["k1", "k2"]).select("query_id", "node", "q", "v"))
    queries = asking.select(F.col("node").alias("query"), "q").dropDuplicates(["query"])
    near = search(queries, indexed, graph, shape, k)
    own = queries.select("query", F.col("query").alias("node"))
    pairs = near.union(own).distinct()
    left = pairs.join(indexed.select(F.col("node").alias("query"), F.col("v").alias("a")), "query")
    both = left.join(indexed.select("node", "ids", F.col("v").alias("b")), "node")
    scored = both.select("query", F.explode("ids").alias("vec_id"), cosine(F.col("a"), F.col("b")).alias("score"))
    order = F.struct((-F.col("score")).alias("far"), "vec_id", "score")
    lists = scored.groupBy("query").agg(F.sort_array(F.collect_list(order)).alias("all"))  # (k + 1) for each node scored anew
    top = asking.select("query_id", F.col("node").alias("query")).join(lists, "query").select(
        "query_id", F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("top")
    )
    return top.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
