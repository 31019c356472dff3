"""Merkle manifest of a table, with nested-interval labels.

Rows of a tree (a source) are ranked by their order column; a node is labelled
with the interval of leaf ranks that it covers. On each level, ``fan`` consecutive
nodes become their parent, until one node covers its whole tree. The roots of
the trees are the leaves of one more tree, built alike, whose root stands for the
table.

Proofs go down the levels: a node joins, within its level's bucket of ranks
(rank divided by the covered width), the node above that contains its interval;
what is left of the parent's interval before and behind its own are its
siblings. They are put before the parent's own proof. A join has at most ``fan``
rows on the lower side of a key, so the size of a tree doesn't matter.

Rows: nulls of any column have a mark of their own in a leaf; a null tree name is
a tree, the first one. Null ids come first in their tree. Equal rows are leaves
of their own, next to each other; rows that differ under one id are ordered by
their leaves. An empty table has no root and an empty result. Extra columns don't
change a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import number_within, settle

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(columns: Sequence[Column]) -> Column:
    """Hash of the values: each "-" if null, else its UTF-8 length, ":" and itself."""
    texts = [c.cast("string") for c in columns]
    return joined_hash(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _is_root() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)


def build(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels of all trees from ``leaves`` (tree, rank, n, hash; other columns stay with them) up.

    Each level is a written table of tree, lo, hi, n, hash and, above the leaves,
    children (lo, hi, hash of each, in order). A tree ends at the level where one
    node covers it, so there are as many levels as the largest tree has.
    """
    levels = [leaves.withColumnRenamed("rank", "lo").withColumn("hi", F.col("lo"))]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    width = 1
    while width < largest:
        width *= fan
        grouped = levels[-1].filter(~_is_root()).groupBy("tree", F.expr(f"lo div {width}L").alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("lo", "hi", "hash"))).alias("children"),
        )
        hashed = joined_hash(F.array_join(F.col("children.hash"), ""))
        levels.append(settle(grouped.select("tree", "lo", "hi", "n", hashed.alias("hash"), "children")))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree and hash of the node that covers each tree."""
    out = None
    for level in levels:
        some = level.filter(_is_root()).select("tree", "hash")
        out = some if out is None else out.unionByName(some)
    return out


def prove(levels: list[DataFrame], above: DataFrame, fan: int = FAN) -> DataFrame:
    """The leaves with their rank and proof, and with the columns of ``above``.

    A proof lists, from the leaf's level up, the hashes of the siblings before
    and behind, each side put together. ``above`` has a row per tree: tree, what
    follows the tree's root in proofs (``proof``), and columns to hand down. Proofs
    go down with the nodes above the leaves; leaves, which are far more, meet only
    those of their run and are moved without them.
    """
    more = [c for c in above.columns if c not in ("tree", "proof")]
    proven = None  # the nodes of the level above with their proofs
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        kept = [*[c for c in level.columns if c != "n"], "proof", *more]
        out = level.filter(_is_root()).join(above, "tree").select(*kept)
        if proven is not None:
            width = fan ** (k + 1)
            up = proven.select(
                F.col("tree"), F.expr(f"lo div {width}L").alias("bucket"), F.col("lo").alias("first"), F.col("hi").alias("last"),
                F.col("children").alias("nodes"), F.col("proof").alias("rest"), *more,
            )
            inner = level.filter(~_is_root()).withColumn("bucket", F.expr(f"lo div {width}L")).join(up, ["tree", "bucket"])
            inner = inner.filter((F.col("first") <= F.col("lo")) & (F.col("hi") <= F.col("last")))
            before = F.array_join(F.filter("nodes", lambda c: c["hi"] < F.col("lo"))["hash"], "")
            behind = F.array_join(F.filter("nodes", lambda c: c["lo"] > F.col("hi"))["hash"], "")
            step = F.array(F.struct(before.alias("before"), behind.alias("behind")))
            out = out.unionByName(inner.withColumn("proof", F.concat(step, "rest")).select(*kept))
        proven = out
    return proven.withColumnRenamed("lo", "rank").drop("hi")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, p: joined_hash(p["before"], h, p["behind"]))


def manifest(rows: DataFrame, order: str, fan: int = FAN) -> DataFrame:
    """Ranks, proofs, subroot and root of rows that have ``__tree`` (a string), ``__leaf`` and the column ``order``.

    Returns the rows with rank, proof, subroot and root.
    """
    placed = settle(settle(rows).orderBy("__tree", F.col(order).asc_nulls_first(), "__leaf"))
    ranked = settle(number_within(placed, ["__tree"], [F.col(order).asc_nulls_first(), "__leaf"], "rank", size="n"))
    levels = build(ranked.withColumnsRenamed({"__tree": "tree", "__leaf": "hash"}), fan)
    subroots = settle(roots(levels).select(F.col("tree").alias("name"), "hash", F.lit("").alias("tree")).orderBy("name"))
    top_levels = build(settle(number_within(subroots, ["tree"], ["name"], "rank", size="n")), fan)
    none = F.array().cast("array<struct<before:string,behind:string>>")
    root = roots(top_levels).select("tree", none.alias("proof"), F.col("hash").alias("root"))
    above = prove(top_levels, root, fan).select(F.col("name").alias("tree"), "proof", F.col("hash").alias("subroot"), "root")
    return prove(levels, settle(above), fan).withColumnsRenamed({"tree": "__tree", "hash": "__leaf"})


def tree_name(column: Column) -> Column:
    """A name for every value, null included, in the order null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def verify(docs: DataFrame, claimed: Column, changed: Column) -> DataFrame:
    """Prove each document's leaf, and check against it the row with ``claimed`` text where ``changed`` holds."""
    fields = [F.col(c) for c in FIELDS]
    other = [claimed if c == "text" else F.col(c) for c in FIELDS]
    leaf = leaf_of(fields)
    rows = docs.select(
        F.col("doc_id"), tree_name(F.col("source")).alias("__tree"), leaf.alias("__leaf"),
        F.when(changed, leaf_of(other)).otherwise(leaf).alias("__seen"),
    )
    folded = fold(F.col("__seen"), F.col("proof"))
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["behind"])), "")
    out = manifest(rows, "doc_id").select(
        "doc_id", F.col("__leaf").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame) -> DataFrame:
    """``verify`` with A-Z lower-cased in the texts of every fifth document by crc32 of its id."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fifth = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return verify(docs, F.translate("text", upper, upper.lower()), F.coalesce(fifth, F.lit(False)))
