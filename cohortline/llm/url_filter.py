"""URL verdicts: host rules first, then naive Bayes over segmented names.

Rules name a host (with all its subdomains) and a start of the path; the longest
that fits decides. Other URLs are scored: host names are cut into runs of letters
(of any script) and of digits, the letters split into words by a unigram Viterbi
pass over word counts of all pages' visible text, paths into their tokens, and a multinomial naive Bayes model, fitted on every URL that a
rule decides, weighs the tokens of host and path.

Tokens are hashed into ``BUCKETS`` counters for each verdict, so the model has
that size whatever the corpus; that is why it may be collected and broadcast.
Word counts stay distributed: the substrings of distinct hosts are joined to
them. Pages meet their host's score under ``SALT`` copies of it, so that one
host may own any share of the pages.

Rows: a null url, or one without ``://``, has an empty host and path, fits no rule
and gets the model's verdict for no tokens. Null and repeated ids are rows like
others. Without URLs decided by rules only the seed words count. Extra columns
are left out.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import settle

#: (verdict, host, path) in the order they are stated.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Words that count as seen in blocked URLs: SEED_COUNT times and once more for each SEED_SHARE of the decided URLs.
SEED_BLOCKED = ("adult", "bet", "betting", "casino", "escort", "gambling", "nude", "poker", "porn", "sex", "slots", "viagra", "warez", "xxx")
SEED_COUNT, SEED_SHARE = 50, 0.2

BUCKETS = 1 << 17
SALT = 64
LONGEST_WORD = 20
_LABEL = 63  # a host label's greatest length by the rules of DNS; longer runs of letters are kept whole
_LETTERS = r"\p{L}\p{M}"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct (rule, verdict) of the longest rule that fits, else null; equally long ones by text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def runs_of(host: Column) -> Column:
    """The runs of letters and of digits in a host, in order, in lower case."""
    return F.regexp_extract_all(F.lower(host), F.lit(rf"[{_LETTERS}]+|\p{{N}}+"), F.lit(0))


def path_tokens(path: Column) -> Column:
    """Lower-case words and numbers of a path; all numbers are one token."""
    parts = F.array_remove(F.split(F.lower(path), rf"[^{_LETTERS}\p{{N}}]+"), "")
    return F.transform(parts, lambda t: F.when(t.rlike(r"^\p{N}+$"), F.lit("#")).otherwise(t))


def word_counts(pages: DataFrame) -> DataFrame:
    """How often each word of letters stands in the visible text of all pages."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?s)<[^>]*>", " "))
    seen = pages.select(F.explode(F.split(text, rf"[^{_LETTERS}]+")).alias("word"))
    return seen.filter(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words of a run of letters (digits stay whole); unknown words cost more the longer they are."""
    if len(name) > _LABEL or unicodedata.category(name[0])[0] == "N":
        return [name]
    base = math.log(max(total, 1))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(name[start:end], 0) or (1 + total // 100_000) * (name[start:end] in SEED_BLOCKED)
            cost = base - math.log(n) if n else base + (end - start) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``words`` of each distinct host. ``counts`` (word, n) must be settled, as it is read twice."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labels = F.filter(runs_of(F.col("host")), lambda x: x.rlike(rf"^[{_LETTERS}]") & (F.length(x) <= _LABEL))
    at = F.flatten(F.transform(labels, lambda x: F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(x)),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length(x) - i + 1)), lambda n: F.substr(x, i, n)),
    ))))
    inside = hosts.select("host", F.explode(F.array_distinct(at)).alias("word"))
    known = inside.join(counts, "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(names: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for parts, found in zip(names, known):
            c = {w["word"]: w["n"] for w in found} if found is not None else {}
            out.append([w for p in parts for w in split_name(p, c, total)])
        return pd.Series(out)

    return hosts.join(known, "host", "left").select("host", split(runs_of(F.col("host")), F.col("known")).alias("words"))


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def fit(decided: DataFrame, hosts: DataFrame) -> tuple[np.ndarray, float]:
    """Log odds of ``block`` for each bucket, and the prior's; from all rows of ``decided`` (host, path, verdict)."""
    spark = decided.sparkSession
    in_paths = decided.select("verdict", F.explode(F.transform(path_tokens(F.col("path")), _bucket)).alias("bucket"), F.lit(1).alias("n"))
    per_host = decided.groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("n"))
    in_hosts = per_host.join(hosts, "host").select("verdict", F.explode(F.transform("words", _bucket)).alias("bucket"), "n")
    sums = in_paths.unionByName(in_hosts).groupBy("bucket", "verdict").agg(F.sum("n").alias("n"))
    seen = np.ones((2, BUCKETS))
    for bucket, verdict, n in sums.collect():  # two counters for each bucket at most
        seen[int(verdict == "block"), bucket] += n
    rows = {r[0]: r[1] for r in decided.groupBy("verdict").count().collect()}
    seeds = spark.createDataFrame([(w,) for w in SEED_BLOCKED], "word string").select(_bucket(F.col("word")))
    for (bucket,) in seeds.collect():
        seen[1, bucket] += SEED_COUNT + SEED_SHARE * sum(rows.values())
    odds = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    return odds, math.log((rows.get("block", 0) + 1) / (rows.get("allow", 0) + 1))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds (of block, where no rule decides) of every page."""
    spark = pages.sparkSession
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    hosts = settle(segmented(read.select("host").distinct(), settle(word_counts(pages))))
    decided = read.filter(F.col("by_rule").isNotNull()).select("host", "path", F.col("by_rule.verdict").alias("verdict"))
    odds, prior = fit(decided, hosts)
    shared = spark.sparkContext.broadcast(odds)

    @F.pandas_udf("double")
    def weigh(buckets: pd.Series) -> pd.Series:
        table = shared.value
        return pd.Series([float(table[np.asarray(b, dtype=np.int64)].sum()) if b is not None and len(b) else 0.0 for b in buckets])

    scores = hosts.select(
        F.col("host").alias("h"), weigh(F.transform("words", _bucket)).alias("host_odds"),
        F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"),
    )
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int")
    met = read.withColumn("salt", salt).join(scores, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")))
    log_odds = F.lit(float(prior)) + F.col("host_odds") + weigh(F.transform(path_tokens(F.col("path")), _bucket))
    return met.withColumn("log_odds", F.when(F.col("by_rule").isNull(), log_odds)).select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"),
        F.coalesce(F.col("by_rule.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"),
        "log_odds",
    )
