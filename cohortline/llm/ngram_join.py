"""Self-join of documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more.

Every link between different sets is found, by parity sketches:

1. A document's n-grams are hashed to 64 bits. Documents with equal sets are one
   class; of the rest, each makes sketches for its own size band and the next
   larger one, where partners up to 1.25 times its size are.
2. A sketch has ``k`` words of 2^64 bits; each n-gram flips one bit of one word,
   so the Hamming distance of two sketches is at most the symmetric difference
   of the sets, which for linked documents of sizes a and b is at most
   ``d = (a + b) / 9``. So at most d words differ (pigeonhole), and of the words
   that hold an n-gram enough are equal. A word is kept as the XOR of the hashes
   of its set bits (2^64 bits don't fit elsewhere).
3. All documents order their words alike, those with many rare n-grams first, so
   linked ones share one of their first d + 1 words. These are the join keys. A
   document with fewer than d + 1 words that hold something also gets a marker
   key of its band, under which it meets its like.
   Which n-grams are frequent is counted over all documents in a pass of its own;
   it decides the order alone, that is the cost, never the result. Size, digest,
   sketch and keys come from one more pass over the texts.
4. Under each key, documents pair with the key's smallest document. A pair goes on
   if sizes allow and a second, 512-bit parity sketch has a distance of at most
   d; then the sets themselves are compared. Linked documents become components.
5. Only keys whose documents are still in several components pair again: those
   outside the key's largest component with all others of another component,
   through the same filters. So copies are never paired among themselves. Two
   documents with an earlier key in common have met there.
6. Components of classes, by propagating the smallest id with pointer jumping.

Nothing is capped or dropped, and nothing but the table of frequent n-grams (of
fixed size) and a bounded list of hot keys goes through the driver.

Rows: null, empty and blank texts have an empty set, link with nothing and are
their own component. Texts of fewer words than n have one n-gram, the whole
sequence. Repeated ids are one document with the links of all its rows. A null
id is left out of links and has a null component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import settle, text_batches

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union. Sizes, bounds and bands below are those of 80.
PERCENT = 80
#: How many documents share a frequent n-gram, and so many slots of the table are marked at most.
SHARED_BY, MOST_SLOTS = 8, 1 << 22
#: Leading bits of an n-gram that name its group and the next ones that are counted there; n-grams that a task sends at once.
GROUP_BITS, REST_BITS, BLOCK = 12, 28, 2_000_000
#: Documents (at most about so many) whose keys are looked at to aggregate hot ones first; all keys are joined either way.
SAMPLE = 20_000
#: Bits of the table of frequent n-grams that is broadcast (2 MB packed); longs of the second sketch.
TABLE_BITS, SKETCH_LONGS = 24, 8
#: A join key counts as hot if so many sampled documents have it; so many hot keys are listed and broadcast.
HOT, HOT_KEYS = 200, 10_000
#: So many candidate pairs, or else ids, may be broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: So many earlier keys of a document stand beside each of its keys, so that pairs with many keys in common meet few times.
EARLIER = 16
REMEMBERED = 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.ones(1, bool)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, known: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(size, len(h))
    n = len(h) - span + 1
    out, factor = np.full(n, np.uint64(span)), 1
    for i in range(span):
        factor = factor * int(_MUL) % (1 << 64)
        out += h[i : n + i] * np.uint64(factor)
    out = _mix(out)
    out.sort()
    fresh = np.ones(n, bool)
    np.not_equal(out[1:], out[:-1], out=fresh[1:])
    return out[fresh]


def _edges(top: int) -> np.ndarray:
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, -(-5 * out[-1] // 4)))
    return np.array(out, np.int64)


#: First sizes of the bands; a linked partner is in the same band or a neighbouring one.
EDGES = _edges(1 << 40)


def words_of_band(band: int) -> int:
    """How many words sketches of a band have: more than can differ, and few enough to hold several n-grams each."""
    high = int(EDGES[band + 1]) - 1
    return max(2 * high // 9 + 1, 28 * high // 100 + 2)


def _band_keys(tokens: np.ndarray, bits: np.ndarray, rare: np.ndarray, band: int) -> np.ndarray:
    n, k = len(tokens), words_of_band(band)
    most = (n + min(5 * n // 4, int(EDGES[band + 1]) - 1)) // 9  # words that may differ from a partner's
    word = ((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    if k <= 1 << 16:
        word = word.astype(np.uint16)  # sorted by counting
    order = np.argsort(word, kind="stable")
    at = word[order]
    starts = np.flatnonzero(np.concatenate((_FIRST, at[1:] != at[:-1])))
    held = at[starts].astype(np.uint64)
    sketch = np.bitwise_xor.reduceat(bits[order], starts)
    key = _mix(_mix(sketch + np.uint64(band)) + held * _MUL)
    if len(held) > most:
        # Ordered by the number of rare n-grams, then of all, then by key: properties of the word alone.
        uncommon = np.add.reduceat(rare[order], starts)
        count = np.diff(starts, append=n)
        rank = (np.minimum(uncommon, 65535) << 47) + (np.minimum(count, 65535) << 31) + (key >> np.uint64(33)).astype(np.int64)
        return key[np.argsort(-rank, kind="stable")[: most + 1]].view(np.int64)
    return np.append(key, _mix(np.array([band], np.uint64) * _MUL)).view(np.int64)


def join_keys(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Join keys of a set for its own band and the next; ``table`` marks frequent n-grams by their leading bits."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    band = int(np.searchsorted(EDGES, len(tokens), side="right")) - 1
    rare = (~table[(tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]).astype(np.int64)
    bits = _mix(tokens * _MUL)
    return np.concatenate([_band_keys(tokens, bits, rare, band), _band_keys(tokens, bits, rare, band + 1)])


def small_sketch(tokens: np.ndarray) -> np.ndarray:
    """The 512-bit parity sketch as longs."""
    bits = np.bincount((tokens >> np.uint64(3)).astype(np.int64) & (64 * SKETCH_LONGS - 1), minlength=64 * SKETCH_LONGS)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both) and both > 0


def _narrow(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def described(docs: DataFrame, table: np.ndarray, size: int = SHINGLE) -> DataFrame:
    """What the join needs of every row, in one pass over the texts.

    doc_id, n (set size), set_id (a 128-bit digest of the set; null if empty), the
    small sketch, and the join keys. Of a set that a partition has seen before,
    the keys aren't made again: a class needs one document of each partition.
    ``table``: see ``frequent_table``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequent, seen = WordHash(), np.unpackbits(shared.value).view(bool), set()
        for b in batches:
            sets = [shingles(t, known, size) for t in b.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            keys = []
            for doc, s, digest in zip(b.column(0).to_pylist(), sets, digests):
                new = doc is not None and digest not in seen
                keys.append(join_keys(s, frequent) if new else np.zeros(0, np.int64))
                if new:
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()),
                _lists([small_sketch(s) for s in sets]), _lists(keys),
            ], names=["doc_id", "n", "set_id", "sketch", "keys"])

    return _narrow(docs).mapInArrow(run, "doc_id long, n long, set_id binary, sketch array<long>, keys array<long>")


def _sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About SAMPLE of the rows, chosen by doc_id."""
    share = min(1.0, SAMPLE / max(rows, 1))
    return docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def _in_groups(tokens: np.ndarray) -> pa.RecordBatch:
    """N-grams as (group, gaps): the leading bits name a group, inside it the next bits are sorted and kept as gaps, byte plane by byte plane."""
    at = np.sort(tokens >> np.uint64(64 - GROUP_BITS - REST_BITS))
    cuts = np.searchsorted(at, np.arange((1 << GROUP_BITS) + 1, dtype=np.uint64) << np.uint64(REST_BITS))
    held = np.flatnonzero(np.diff(cuts))
    rest = (at & np.uint64((1 << REST_BITS) - 1)).astype(np.uint32)
    gaps = np.diff(rest, prepend=np.uint32(0))
    gaps[cuts[held]] = rest[cuts[held]]
    blobs = [gaps[cuts[g] : cuts[g + 1]].view(np.uint8).reshape(-1, 4).T.tobytes() for g in held]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(blobs, pa.binary())], names=["group", "gaps"])


def _levels(blobs: list[bytes]) -> np.ndarray:
    """Of the slots of a group, the highest level that an n-gram of it has: 0 below SHARED_BY documents, one more from each doubling."""
    rest = [np.ascontiguousarray(np.frombuffer(g, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().cumsum(dtype=np.uint32) for g in blobs]
    value, count = np.unique(np.concatenate(rest), return_counts=True)
    often = count >= SHARED_BY
    out = np.zeros(1 << (TABLE_BITS - GROUP_BITS), np.uint8)
    level = 1 + np.log2(count[often] // SHARED_BY).astype(np.uint8)
    np.maximum.at(out, value[often] >> np.uint32(REST_BITS - TABLE_BITS + GROUP_BITS), level)
    return out


def frequent_table(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Leading bits of n-grams that SHARED_BY of all documents share, or so many more that at most MOST_SLOTS are marked.

    Every n-gram of every document is counted, told apart by its GROUP_BITS + REST_BITS leading bits. Tasks send them
    in sorted blocks of a few bytes an n-gram; the driver gets a byte for each slot of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, total = WordHash(), [], 0
        for b in batches:
            for text in b.column(1).to_pylist():
                held.append(shingles(text, known, size))
                total += len(held[-1])
                if total >= BLOCK:
                    yield _in_groups(np.concatenate(held))
                    held, total = [], 0
        if total:
            yield _in_groups(np.concatenate(held))

    def count(key: tuple, blocks: pa.Table) -> pa.Table:
        levels = _levels(blocks.column("gaps").to_pylist())
        return pa.table({"group": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    sent = _narrow(docs).mapInArrow(run, "group int, gaps binary")
    table = np.zeros((1 << GROUP_BITS, 1 << (TABLE_BITS - GROUP_BITS)), np.uint8)
    for r in sent.groupBy("group").applyInArrow(count, "group int, levels binary").collect():  # 2^TABLE_BITS bytes at most
        table[r[0]] = np.frombuffer(r[1], np.uint8)
    marked = np.bincount(table.ravel(), minlength=256)[::-1].cumsum()[::-1]  # slots of a level or a higher one
    least = next(level for level in range(1, 256) if marked[level] <= MOST_SLOTS)
    return np.packbits(table.ravel() >= least)


def met(wide: DataFrame, rows: int) -> DataFrame:
    """key, doc_id, head for groups of documents that have a join key in common; head is the smallest of them.

    ``wide`` is a written table. Keys that many documents of a sample of it share
    are aggregated before they are shuffled, the others meet in a window; which
    keys go which way decides the cost alone.
    """
    keyed = wide.select(F.explode("keys").alias("key"), "doc_id")
    some = _sampled(wide, rows).select(F.explode("keys").alias("key")).groupBy("key").count()
    most = some.filter(F.col("count") >= HOT).orderBy(F.desc("count"), "key").limit(HOT_KEYS)
    hot = [(r[0],) for r in most.select("key").collect()]
    own = Window.partitionBy("key")
    # Copies share nearly all of their keys, so keys of the same documents are one: the hash of the group takes their
    # place. Should two groups ever have one hash, their documents only meet once more than they have to.
    group = [F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.bit_xor(F.xxhash64("doc_id"))]
    names = ["head", "last", "n", "mix"]
    if hot:
        listed = F.broadcast(wide.sparkSession.createDataFrame(hot, "key long"))  # HOT_KEYS rows at most
        crowded = keyed.join(listed, "key", "left_semi")
        ends = crowded.groupBy("key").agg(*[g.alias(n) for g, n in zip(group, names)])
        crowded = crowded.join(F.broadcast(ends), "key")
        keyed = keyed.join(listed, "key", "left_anti")
    both = keyed.withColumns({n: g.over(own) for g, n in zip(group, names)})
    if hot:
        both = both.unionByName(crowded)
    met_again = both.filter(F.col("head") < F.col("last"))
    return met_again.select(F.xxhash64(*names).alias("key"), "doc_id", "head").distinct()


def _possible(a_n: Column, b_n: Column, a_sketch: Column, b_sketch: Column) -> Column:
    """What sizes and small sketches don't rule out."""
    distance = sum(
        (F.bit_count(F.get(a_sketch, F.lit(i)).bitwiseXOR(F.get(b_sketch, F.lit(i)))) for i in range(SKETCH_LONGS)), F.lit(0)
    )
    sizes = F.least(a_n, b_n) * 100 >= F.greatest(a_n, b_n) * PERCENT
    return sizes & (distance * 9 <= a_n + b_n)


def _verified(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) that are links; texts of just their documents are read into sets."""
    pairs = settle(pairs)
    few = pairs.count() <= BROADCAST_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([shingles(t, known, size).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "s"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    def sets(ids: DataFrame) -> DataFrame:
        return _narrow(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, s binary")

    if few:  # pairs go to the sets of b, so that these are moved once
        of_a, of_b = (sets(F.broadcast(pairs.select(F.col(c).alias("doc_id")).distinct())) for c in "ab")
        pairs = F.broadcast(pairs)
    else:
        ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        of_a = of_b = sets(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids)
    left = pairs.join(of_b.select(F.col("doc_id").alias("b"), F.col("s").alias("s_b")), "b")
    whole = left.join(of_a.select(F.col("doc_id").alias("a"), F.col("s").alias("s_a")), "a")
    return settle(whole.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest reachable node) of every node of the edges (a, b)."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).filter(F.col("a") != F.col("b")).distinct())
    state = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("other"))
        lower = state.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("component").alias("was"), F.least("component", "other").alias("component")
        )
        lower = settle(lower)
        jumped = lower.join(lower.select(F.col("node").alias("at"), F.col("component").alias("further")), F.col("component") == F.col("at"), "left")
        state = settle(jumped.select("node", "was", F.least("component", "further").alias("component")))
        if state.filter(F.col("was") != F.col("component")).isEmpty():
            return state.select("node", "component")
        state = state.select("node", "component")


def links(docs: DataFrame, every: DataFrame, keyed: DataFrame, rows: int, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) between different documents, as many as it takes to connect every component.

    ``every`` and ``keyed``: the written table of ``described`` without and with keys. Ids with several sets have no
    size and sketch of their own, so their pairs are all verified, set by set.
    """
    one = F.min("set_id") == F.max("set_id")
    about = every.filter(F.col("set_id").isNotNull()).groupBy("doc_id").agg(
        F.when(one, F.max("n")).alias("n"), F.when(one, F.max_by("sketch", "n")).alias("sketch")
    )
    under = settle(met(keyed, rows))
    known = settle(under.select("doc_id").distinct().join(about, "doc_id"))
    a = known.select(F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    b = known.select(F.col("doc_id").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    fits = F.coalesce(_possible(F.col("a_n"), F.col("b_n"), F.col("a_sketch"), F.col("b_sketch")), F.lit(True))
    stars = under.filter(F.col("head") < F.col("doc_id")).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = _verified(stars.join(b, "b").join(a, "a").filter(fits).select("a", "b"), docs, size)

    joined = under.join(components(found).withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("c")
    )
    pairs = crossed(settle(joined), known).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return settle(found.unionByName(_verified(pairs, docs, size)))


def crossed(placed: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents in different components ``c`` with a key in common, as far as sizes and sketches allow.

    ``placed``: the written table key, doc_id, c; ``known``: doc_id, n, sketch. Documents that are alike share hundreds of
    keys. Each brings the EARLIER keys before this one, in the order of keys, and two that have one of those in common
    have met there. Under their first key they have none, so every pair is met at least once.
    """
    counts = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    mixed = counts.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("largest"), F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1)
    mixed = settle(mixed.select("key", "largest"))
    before = Window.partitionBy("doc_id").orderBy("key").rowsBetween(-EARLIER, -1)  # the keys of one document
    some = placed.join(mixed, "key").withColumn("earlier", F.collect_list("key").over(before)).join(known, "doc_id")
    outside = some.filter(F.col("c") != F.col("largest")).select(
        "key", F.col("doc_id").alias("a"), F.col("c").alias("a_c"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"),
        F.col("earlier").alias("a_earlier"),
    )
    others = some.select(
        F.col("key").alias("k"), F.col("doc_id").alias("b"), F.col("c").alias("b_c"), F.col("n").alias("b_n"),
        F.col("sketch").alias("b_sketch"), F.col("earlier").alias("b_earlier"), "largest",
    )
    # Two documents outside the largest component meet once, one inside it is always b.
    once = (F.col("b_c") == F.col("largest")) | (F.col("a") < F.col("b"))
    fits = F.coalesce(_possible(F.col("a_n"), F.col("b_n"), F.col("a_sketch"), F.col("b_sketch")), F.lit(True))
    new = ~F.arrays_overlap("a_earlier", "b_earlier")
    return outside.join(others, (F.col("key") == F.col("k")) & (F.col("a_c") != F.col("b_c")) & once & fits & new).select("a", "b")


def join(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = docs.count()
    keyed = settle(described(docs, frequent_table(docs, size), size))
    every = settle(keyed.drop("keys"))
    classes = settle(every.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("least")))
    # Both sides are written tables, so adaptive execution can split the class of a third of all rows.
    placed = every.select("doc_id", "n", "set_id").join(classes, "set_id", "left").select("doc_id", "n", F.coalesce("least", "doc_id").alias("least"))
    same = placed.filter(F.col("least") < F.col("doc_id")).select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    whole = components(links(docs, every, keyed, rows, size).unionByName(same))
    return placed.join(whole, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The document of the smallest id of each component, with its columns; of rows with one id, one stays.

    Rows with a null id stay. Texts are moved only if the ids that go are too many to broadcast.
    """
    found = settle(join(docs, size))
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = settle(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter(F.col("count") > 1).select("doc_id"))
    if twice.isEmpty():
        return left
    once = left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
