"""Periodic runs, vector packing and manifests next to plain Python versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortline.llm import manifest, periodic_runs, vector_packing
from cohortline.llm.common import load
from cohortline.llm.queries import QUERIES, TOKENIZER
from tests.llm import helpers
from tests.llm.helpers import rows

PATH = public_tokenizers.path(TOKENIZER)
DIGEST = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


# Periodic runs


def repetitive(seed):
    rng, w = random.Random(seed), []
    while len(w) < rng.randint(20, 300):
        unit = [rng.choice("abc") if rng.random() < 0.8 else str(rng.random()) for _ in range(rng.randint(1, 40))]
        w += unit * rng.randint(1, 6)
        if rng.random() < 0.3:
            w += rng.choices("ab", k=rng.randint(1, 40))
    return w


def test_runs_equal_those_of_all_lags():
    for seed in range(300):
        w = repetitive(seed)
        assert periodic_runs.runs_of(w) == helpers.periodic_runs(w)


@pytest.mark.parametrize("shortest, repeats", [(5, 3), (6, 3), (40, 3), (12, 5), (2, 4)])
def test_runs_of_other_lengths(shortest, repeats):
    for seed in range(100):
        w = repetitive(seed)
        assert periodic_runs.runs_of(w, shortest, repeats) == helpers.periodic_runs(w, shortest, repeats)


def test_rare_words_split_until_nothing_changes():
    # b is common in the whole, but its places are parted by words that occur once
    w = ["b", "x1", "b"] + ["a"] * 30 + ["x2", "b"]
    ids = np.unique(w, return_inverse=True)[1]
    assert periodic_runs.segments(ids) == [(3, 33)]
    assert periodic_runs.runs_of(w) == [(3, 30, 1)]


def expected_digest(doc, text):
    w = helpers.tiled(doc, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = helpers.periodic_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, helpers.sha(lines), helpers.sha(left))


def test_run_query_on_odd_rows(odd_docs, no_docs, odd_pairs):
    def found(docs):
        return periodic_runs.digest(periodic_runs.find(periodic_runs.planted(docs)))

    small = [(i, t) for i, t in odd_pairs if len(t or "") < 50_000]
    got = Counter(rows(found(odd_docs.filter("text is null or length(text) < 50000")), *DIGEST))
    assert got == Counter(expected_digest(i, t) for i, t in small)
    assert found(odd_docs).count() == len(odd_pairs)
    assert found(no_docs).collect() == []


def test_a_long_text_of_one_word_is_one_run(spark):
    docs = spark.createDataFrame([(1, "a " * 200_000), (2, "a b " * 100_000 + "c")], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find(docs).collect()}
    assert got == {1: ([(0, 200_000, 1)], "a"), 2: ([(0, 200_000, 2)], "a b c")}


def test_runs_keep_other_columns_and_replace_their_own(spark):
    docs = spark.createDataFrame([(1, "k " * 30, 5, "old")], "doc_id long, text string, key int, runs string")
    r = periodic_runs.find(docs).collect()[0]
    assert (r["key"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (5, [(0, 30, 1)], "k")
    with pytest.raises(ValueError):
        periodic_runs.find(docs, repeats=2)


# Vector packing


def check_vectors(got, wanted, tokens=4096, segments=128, loss=3584):
    """Limits, gapless places, no padding, and every id in one piece; wanted: Counter of (doc_id, ids)."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["loss_tokens"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for places in sequences.values():
        at = 0
        for offset, length, _ in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at == tokens or at & (at - 1) == 0
        assert at <= tokens and len(places) <= segments and sum(p[2] for p in places) <= loss
    want = defaultdict(list)
    for doc, ids in wanted:
        want[doc].append(np.array(ids, "<u4"))
    assert set(pieces) == set(want)
    for doc, texts in want.items():
        if len(texts) == 1:
            at = 0
            for start, length, crc, whole in sorted(pieces[doc]):
                assert start == at and crc == zlib.crc32(texts[0][at : at + length].tobytes()) and whole == len(texts[0])
                at += length
            assert at == len(texts[0])
        else:
            assert sum(p[1] for p in pieces[doc]) == sum(map(len, texts))


def tokenized(pairs, end=2):
    t = Tokenizer.from_file(PATH)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x in pairs]


def test_vector_packing_of_odd_rows(odd_docs, no_docs, odd_pairs):
    check_vectors(vector_packing.pack(odd_docs, PATH).collect(), tokenized(odd_pairs))
    narrow = {"tokens": 64, "segments": 3, "loss": 40}
    check_vectors(vector_packing.pack(odd_docs, PATH, **narrow).collect(), tokenized(odd_pairs), **narrow)
    assert vector_packing.pack(no_docs, PATH).collect() == []
    with pytest.raises(ValueError):
        vector_packing.pack(no_docs, PATH, loss=0)


def test_vector_packing_query(spark, sf):
    docs = load(spark, sf, "documents")
    got = QUERIES["op12_vector_packing"](spark, sf).collect()
    check_vectors(got, tokenized(rows(docs, "doc_id", "text")))


def test_prompts_bear_no_loss(spark):
    turns = spark.createDataFrame([(1, "ask me", "yes indeed"), (2, None, "no"), (3, "only", None)], "doc_id long, ask string, text string")
    got = defaultdict(lambda: ([], []))
    for r in sorted(vector_packing.pack(turns.coalesce(1), PATH, prompt="ask", with_ids=True).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]][0].extend(r["ids"])
        got[r["doc_id"]][1].append(r["loss_tokens"])
    t = Tokenizer.from_file(PATH)
    for doc, ask, text in rows(turns, "doc_id", "ask", "text"):
        before, after = (t.encode(x or "", add_special_tokens=False).ids for x in (ask, text))
        assert got[doc][0] == [*before, *after, 2] and sum(got[doc][1]) == len(after) + 1


@pytest.mark.parametrize("seed", range(20))
def test_pieces_are_chosen_by_dot_product(seed):
    rng = random.Random(seed)
    packer = vector_packing.Packer(100, 10, 80)
    items = []
    for i in range(30):
        n = rng.randint(1, 60)
        prompt = rng.randint(0, n)
        packer.add(i, n, prompt)
        items.append((n, 1, n - prompt))
    weights = list(items)
    room, limits = [100, 10, 80], [100, 10, 80]
    got = packer.fill()
    for example, lo, hi, _ in got:
        if room[1] == 1 or lo or hi - lo < weights[example][0]:
            break  # the last one is cut
        left = [x if x in items else None for x in items]
        total = [sum(i[d] for i in weights) / limits[d] for d in range(3)]

        def worth(x, total=total):
            return sum(total[d] / sum(total) * room[d] / limits[d] * x[d] / limits[d] for d in (0, 2))

        fits = [x for x in left if x and all(x[d] <= room[d] for d in range(3))]
        assert worth(items[example]) >= max(map(worth, fits)) - 1e-12
        room = [a - b for a, b in zip(room, items[example])]
        items[example] = None


# Manifests


def test_manifest_on_odd_rows(spark, odd_docs, no_docs):
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    got = Counter(tuple(r) for r in manifest.tampered(odd_docs).collect())
    assert got == Counter(helpers.manifest(rows(odd_docs, *cols)))
    assert manifest.tampered(no_docs).collect() == []


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 16, 17), (256, 257, 3), (1,) * 40])
def test_trees_of_all_heights(spark, sizes):
    docs = [(i, None if s == 0 else f"s{s:02d}" if s % 2 else f"é{s}", "en", i % 7 or None, f"T{i}") for s, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert Counter(tuple(r) for r in manifest.tampered(df).collect()) == Counter(helpers.manifest(docs))


def test_a_changed_row_fails_alone_and_another_fan_works(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "'abc' as text")
    got = manifest.verify(docs, F.lit("abd"), F.col("doc_id") == 7).collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [7]
    leaves = docs.select(F.lit("t").alias("tree"), F.col("doc_id").alias("rank"), F.lit(50).cast("long").alias("n"), F.sha2(F.col("doc_id").cast("string"), 256).alias("hash"))
    levels = manifest.build(leaves, fan=3)
    assert manifest.roots(levels).collect()[0]["hash"] == helpers.merkle([helpers.sha(str(i)) for i in range(50)], 3)[0]
    inner = {(r["lo"], r["hi"]) for r in levels[2].collect()}
    assert inner == {(9 * k, min(9 * k + 8, 49)) for k in range(6)}


def test_new_queries_have_their_columns(spark, sf):
    assert QUERIES["op11_periodic_runs"](spark, sf).columns == DIGEST
    assert QUERIES["op13_merkle_manifest"](spark, sf).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
