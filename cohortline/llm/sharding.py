"""Shards by a weighted hash tree: region, rack, shard.

Every node draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the
node, and the smallest draw wins, so a node is chosen with a probability in
proportion to its weight, and a change of one node's weight moves rows only into
or out of that node. A row descends from the regions to the racks of the region
it won and on to the shards of that rack.

A region that has grown draws once for the weight it was built with and once for
each shard added since. The least of several exponential draws is an exponential
draw of the summed weight, so the region keeps its exact share; and a row won by
an added shard's draw follows the path to that shard, while every other row
keeps its place. So an added shard takes rows only into itself.

Rows: a null key hashes like any other value. A null text counts as no bytes,
its checksum is that of the empty text. Equal rows share a shard and get slots
of their own. Extra columns pass through; clashes with the names added here are
replaced by them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import number_within, settle


@dataclass(frozen=True)
class Leaf:
    """One shard and its place in the tree; ``added`` shards came after the tree was built."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0
    added: bool = False


def topology(shards: int, built: int | None = None, per_rack: int = 2, racks_per_region: int = 5) -> list[Leaf]:
    """Shards 0..shards-1 in racks and regions filled in order; those from ``built`` on count as added."""
    built = shards if built is None else built
    return [
        Leaf(i // (per_rack * racks_per_region), i // per_rack, i, 1.0, i >= built)
        for i in range(shards)
    ]


def _draw(row: Column, level: str, node: Column, weight: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(row, F.lit(level), node), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**53))) / weight


def _nodes(weights: dict[int, float]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).cast("int").alias("node"), F.lit(float(w)).alias("weight")) for i, w in sorted(weights.items())
    ])


def _winner(row: Column, level: str, nodes: Column) -> Column:
    """The node of the smallest draw (ties: the smaller node); struct (draw, node)."""
    return F.array_min(F.transform(
        nodes, lambda n: F.struct(_draw(row, level, n["node"], n["weight"]).alias("draw"), n["node"].alias("node"))
    ))


def _sums(leaves: Sequence[Leaf], key) -> dict[int, float]:
    out: dict[int, float] = {}
    for x in leaves:
        out[key(x)] = out.get(key(x), 0.0) + x.weight
    return out


def with_shard(df: DataFrame, key: str, tree: Sequence[Leaf], name: str = "shard") -> DataFrame:
    """Add the shard (int) that the tree gives to ``key``; no shuffle, no state."""
    if not tree or any(x.weight <= 0 for x in tree):
        raise ValueError("a tree needs shards, each with a positive weight")
    base, added = [x for x in tree if not x.added], [x for x in tree if x.added]
    if not base:
        raise ValueError("a tree needs shards it was built with")
    racks_of = {r: _sums([x for x in base if x.region == r], lambda x: x.rack) for r in {x.region for x in base}}
    shards_of = {k: _sums([x for x in base if x.rack == k], lambda x: x.shard) for k in {x.rack for x in base}}
    by_region = F.create_map(*[c for r, w in sorted(racks_of.items()) for c in (F.lit(r), _nodes(w))])
    by_rack = F.create_map(*[c for k, w in sorted(shards_of.items()) for c in (F.lit(k), _nodes(w))])
    row = F.xxhash64(F.col(key))
    region = _winner(row, "region", _nodes(_sums(base, lambda x: x.region)))
    df = df.withColumn("__region", region)
    df = df.withColumn("__rack", _winner(row, "rack", F.element_at(by_region, F.col("__region.node")))["node"])
    df = df.withColumn("__leaf", _winner(row, "shard", F.element_at(by_rack, F.col("__rack")))["node"])
    shard = F.col("__leaf")
    if added:
        grown = _winner(row, "added", _nodes(_sums(added, lambda x: x.shard)))
        shard = F.when(grown["draw"] < F.col("__region.draw"), grown["node"]).otherwise(shard)
    return df.withColumn(name, shard.cast("int")).drop("__region", "__rack", "__leaf")


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard with one more for each row; the text itself isn't kept or moved.

    Only narrow rows (key, size, checksum, shards) are written and shuffled.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + F.lit(16)).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = with_shard(narrow, key, topology(shards), "shard")
    placed = with_shard(placed, key, topology(shards + 1, built=shards), "grown_shard")
    numbered = number_within(settle(placed), ["shard"], [key, "size", "text_crc32"], "slot")
    return numbered.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
