"""Benchmark decontamination with DataFrame functions only.

Benchmark items become windows of ``window`` normalised words (an item of fewer
words is one window of its own length). Windows are keyed by a hash of their
words' hashes; documents are scanned for the same keys at each word, hits are
verified word by word, and hit spans or whole documents are removed.

The window table is broadcast while it has at most ``BROADCAST_WINDOWS`` rows,
which is counted first; a larger one is joined by shuffle, with the same result.
Either way a row of the scan holds the words of one window, so the work grows with
the length of a text, not with its square.
Documents' window keys are made and joined in one pass without a shuffle; only
hits and one row per document go on, pre-aggregated where they were found.

Words: A-Z are lower-cased, then the runs of digits, letters a-z and characters
beyond ASCII. Rows: a null text has no words and is never hit. A null item text
has no window; a null item_id counts in ``n_items`` and is left out of the digest.
Equal documents are judged each on its own row; equal items each count under
their id. Without items nothing is hit. Extra columns pass through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import settle

WINDOW = 10
BROADCAST_WINDOWS = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(word: Column) -> Column:
    """A-Z to a-z; only words with other characters need the slow way, as ``lower`` would change those too."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The normalised words of a text; empty for a null text."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), _SEPARATORS)
    return F.transform(F.array_remove(parts, ""), _lowered)


def _keys(hashes: Column, length: Column) -> Column:
    """The key of the window of ``length`` words at each word where one fits."""
    last = F.size(hashes) - length
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(
        i.alias("pos"), length.alias("span"), F.xxhash64(F.slice(hashes, i + 1, length)).alias("key")
    ))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: key, span (words), window (the words), items (ids of the items that hold it)."""
    cut = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = cut.withColumn("span", F.least(F.size("w"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("span")))
    placed = cut.select("item_id", "w", "span", at.alias("pos")).select(
        F.struct("item_id").alias("item"), "span", F.slice("w", F.col("pos") + 1, F.col("span")).alias("window")
    )
    keyed = placed.withColumn("key", F.xxhash64(F.transform("window", lambda w: F.xxhash64(w))))
    return keyed.groupBy("key", "span", "window").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the carried columns, n_words, items, and ``found`` (pos, span) sorted, empty if not hit."""
    grams = settle(windows(benchmark, window))
    known = {int(r["span"]): int(r["n"]) for r in grams.groupBy("span").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans = sorted(known)  # at most ``window`` lengths
    listed = docs.select(*carry, words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("__row"))
    listed = listed.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    empty = F.array().cast("array<struct<pos:int,span:int,key:bigint>>")
    keys = F.concat(empty, *[_keys(F.col("h"), F.lit(s)) for s in spans])
    # One more entry, at -1, stands for the document itself, so that no document is lost in the join. It has a span
    # that no window has, and a key of its own, so that a join by shuffle deals these entries out.
    itself = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("span"), F.xxhash64("__row").alias("key")))
    placed = listed.select(*carry, "__row", "w", F.size("w").cast("long").alias("n_words"), F.inline(F.concat(itself, keys)))
    # A row goes on with the words of its own window, not with those of the whole text.
    here = F.when(F.col("pos") >= 0, F.slice("w", F.col("pos") + 1, F.col("span")))
    own = [F.when(F.col("pos") < 0, F.col(c)).alias(c) for c in carry]
    placed = placed.select(*own, "__row", "n_words", "pos", "span", "key", here.alias("here"))
    right = grams.select(F.col("key").alias("g_key"), F.col("span").alias("g_span"), "window", "items")
    if sum(known.values()) <= BROADCAST_WINDOWS:
        right = F.broadcast(right)
    joined = placed.join(right, (F.col("key") == F.col("g_key")) & (F.col("span") == F.col("g_span")), "left")
    verified = F.col("here") == F.col("window")
    kept = joined.filter((F.col("pos") == -1) | verified)
    found = kept.select(
        *carry, "__row", "n_words", "items", F.when(F.col("pos") >= 0, F.struct("pos", "span")).alias("at")
    )
    return found.groupBy("__row").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.sort_array(F.collect_set("at")).alias("found"),
    )


def covered(found: Column) -> Column:
    """How many words the sorted spans cover together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(found, start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["pos"] + x["span"] - F.greatest(a["end"], x["pos"]))).alias("n"),
        F.greatest(a["end"], x["pos"] + x["span"]).alias("end"),
    ))["n"]


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    ids = F.array_sort(F.filter(F.transform("items", lambda x: x["item_id"].cast("string")), lambda x: x.isNotNull()))
    n_hit = covered(F.col("found")).cast("long")
    return hits(docs, benchmark, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", ids), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """The documents without contaminated ones, or (``remove="spans"``) all documents without the hit words.

    A removed word takes the separators before it along. ``n_chars``, where there is
    such a column, follows the text. Columns and untouched rows stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError('remove is "documents" or "spans"')
    if remove == "documents":
        # Texts stay where they are unless the hit ones are too many to broadcast; rows of one id and text share their fate.
        keyed = docs.select(
            F.struct("*").alias("__doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"), F.xxhash64("text").alias("__text"), "text"
        )
        hit = hits(keyed.select("__id", "__text", "text"), benchmark, window, ("__id", "__text")).filter(F.size("found") > 0)
        return keyed.join(hit.select("__id", "__text").distinct(), ["__id", "__text"], "left_anti").select("__doc.*")
    # The row travels as one struct, so that its columns' names can't meet those used here.
    found = hits(docs.select(F.struct("*").alias("__doc"), "text"), benchmark, window, ("__doc", "text"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).*?{_WORD}"), F.lit(0))
    tail = F.regexp_replace("text", f"(?s)^.*{_WORD}", "")
    # Spans are merged first, so that a word asks only a few of them.
    merged = F.aggregate(
        "found", F.array().cast("array<struct<pos:int,span:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(1))["pos"]
                               + F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(1))["span"] >= x["pos"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                F.element_at(a, -1)["pos"].alias("pos"),
                F.greatest(F.element_at(a, -1)["span"], x["pos"] + x["span"] - F.element_at(a, -1)["pos"]).alias("span"),
            ))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    found = found.withColumn("__merged", F.when(F.size("found") > 0, merged))
    left = F.filter(pieces, lambda _, i: ~F.exists("__merged", lambda s: (i >= s["pos"]) & (i < s["pos"] + s["span"])))
    text = F.when(F.size("found") > 0, F.concat(F.array_join(left, ""), tail)).otherwise(F.col("text"))
    doc = F.col("__doc").withField("text", text)
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(F.size("found") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__doc.n_chars")))
    return found.select(doc.alias("__doc")).select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
