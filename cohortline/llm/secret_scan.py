"""Secret scans with multipart credential linking, with DataFrame functions only.

Parts of credentials are found as spans: ``assign`` (a name and its value),
``access`` (access identifiers) and ``hex`` (long hexadecimal runs) always count.
Two weak kinds mean little alone: ``key`` (long mixed base-64 runs) and
``endpoint`` (addresses). A weak part counts only where complementary parts start
within ``reach`` code points of it, its scope: a key needs an access identifier,
an endpoint needs an access identifier and a secret (assign, hex or key).

Places come from the lengths of matches and of the text between them: a running
sum over a document's own matches. Scopes are an interval join: strong parts are
put into their bin of ``reach`` code points and both neighbours, weak parts into
their own bin, and equal bins of a document are joined. Matches of one kind don't
overlap, so a bin holds a bounded number of parts and the join grows with the
number of parts. Only narrow rows (row number, kind, places) are written or moved.

Rows: a null text is empty and has no span; every row is reported, equal rows
each on its own. Extra columns pass through ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import settle

#: How far apart, in code points, the starts of complementary parts may be.
REACH = 400
MASK = "[SECRET]"

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Kind:
    """Spans of ``pattern`` that ``keep`` accepts; ``number`` is the order of kinds that start together."""

    name: str
    number: int
    pattern: str
    keep: object
    weak: bool = False


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


KINDS = (
    Kind("assign", 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    Kind("access", 1, r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    # A run is taken whole from its first digit, so asking for 24 drops just the shorter runs.
    Kind("hex", 2, r"[0-9a-f]{24,}", lambda m: F.lit(True)),
    Kind("key", 3, r"[A-Za-z0-9+/]{32,}", _mixed, weak=True),
    Kind("endpoint", 4, r"""https?://[^\x00-\x20"'<>]+""", lambda m: F.lit(True), weak=True),
)

_PART = "array<struct<kind:int,i:int,gap:bigint,size:bigint,ok:boolean>>"


def _matches(text: Column, kind: Kind) -> Column:
    """A part for each match: its number, the length of the text before it (from the last match) and its own."""
    gaps = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x, i: F.struct(
        F.lit(kind.number).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("bigint").alias("gap"),
        F.length(x["hit"]).cast("bigint").alias("size"), F.coalesce(kind.keep(x["hit"]), F.lit(False)).alias("ok"),
    ))


def parts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Narrow rows: the carried columns, __row, kind, start, end; and one row of null kind for each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    itself = F.array(F.struct(
        F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("gap"),
        F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("ok"),
    ))
    found = F.concat(itself.cast(_PART), *[
        F.filter(_matches(text, k), lambda x: x["size"].isNotNull()).cast(_PART) for k in KINDS
    ])
    numbered = docs.select(*carry, "text", F.monotonically_increasing_id().alias("__row"))
    rows = numbered.select(*carry, "__row", F.inline(found))
    before = Window.partitionBy("__row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).filter("ok")
    return placed.select(
        *carry, "__row", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"),
        (F.col("end") - F.col("size")).alias("start"), "end",
    )


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Spans that count: strong ones, and weak ones with their complements in scope. ``found`` is read several times."""
    weak_kinds = [k.number for k in KINDS if k.weak]
    access, key = KINDS[1].number, KINDS[3].number
    strong = found.filter(F.col("kind").isNull() | ~F.col("kind").isin(weak_kinds))
    weak = found.filter(F.col("kind").isin(weak_kinds))
    bin_of = F.floor(F.col("start") / reach)
    around = found.filter(F.col("kind") <= key).select(
        F.col("__row").alias("o_row"), F.col("kind").alias("o_kind"), F.col("start").alias("o_start"),
        F.explode(F.sequence(bin_of - 1, bin_of + 1)).alias("o_bin"),
    )
    near = weak.withColumn("bin", bin_of).join(
        around,
        (F.col("__row") == F.col("o_row")) & (F.col("bin") == F.col("o_bin")) & (F.abs(F.col("start") - F.col("o_start")) <= reach),
    )
    complete = near.groupBy(*found.columns).agg(
        F.max(F.col("o_kind") == access).alias("has_access"), F.max(F.col("o_kind") != access).alias("has_secret")
    ).filter(F.col("has_access") & ((F.col("kind") == key) | F.col("has_secret")))
    return strong.unionByName(complete.select(*found.columns))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
    )), ",")


def report(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Counts and digests of the spans of every document."""
    spans = linked(settle(parts(docs)), reach)
    by_row = spans.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind") == k.number, 1)).alias(f"n_{k.name}") for k in KINDS],
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("s"),
    )
    base = F.filter("s", lambda x: x["kind"] < 3)
    return by_row.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.col("s")).alias("spans"), "n_key", "n_endpoint",
    )


def redact(docs: DataFrame, reach: int = REACH, mask: str = MASK) -> DataFrame:
    """All documents, with each run of overlapping spans replaced by the mask; ``n_chars``, if there, follows.

    Spans come back to their texts by id and text, so rows without spans aren't changed.
    """
    # The row travels as one struct, so that its columns' names can't meet those used here.
    keyed = docs.select(
        F.struct("*").alias("__doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"), F.xxhash64("text").alias("__text"), "text"
    )
    found = settle(parts(keyed.select("__id", "__text", "text"), ("__id", "__text")))
    spans = linked(found, reach).filter(F.col("kind").isNotNull())
    by_text = spans.groupBy("__id", "__text").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate(
        F.slice("s", 2, F.size("s")), F.slice("s", 1, 1),
        lambda a, x: F.when(
            last(a)["end"] >= x["start"],
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    joined = keyed.join(by_text.select("__id", "__text", merged.alias("__m")), ["__id", "__text"], "left")
    before = F.transform("__m", lambda x, i: F.concat(
        F.expr("text").substr(F.coalesce(F.get("__m", i - 1)["end"], F.lit(0)).cast("int") + 1,
                              (x["start"] - F.coalesce(F.get("__m", i - 1)["end"], F.lit(0))).cast("int")),
        F.lit(mask),
    ))
    rest = F.expr("substring(text, int(element_at(__m, -1).end) + 1)")
    hit = F.col("__m").isNotNull()
    text = F.when(hit, F.concat(F.array_join(before, ""), rest)).otherwise(F.col("text"))
    doc = F.col("__doc").withField("text", text)
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__doc.n_chars")))
    return joined.select(doc.alias("__doc")).select("__doc.*")
