"""Feature preparation, windows and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query, rounded
from cohortline.catalog.tables import binary_scores, load, surveys, with_views
from cohortline.operators import prep as P
from cohortline.operators import text as X
from cohortline.operators.windows import scale_sequences, sequences_with_label, sliding_windows

FOLD = "cast(snapshot_id % 5 + 1 as int)"


def _folded(spark, sf):
    return surveys(spark, sf).select("id", "snapshot_id", "stress_d", "f1", "f2", "f3", (F.col("snapshot_id") % 5 + 1).cast("int").alias("fold"))


_STATS = """s as (select *, cast(snapshot_id % 5 + 1 as int) as fold from surveys),
k as (select distinct fold from s),
t as (select k.fold, avg(f1) as m1, avg(f2) as m2, stddev_pop(f1) as d1, stddev_pop(f2) as d2, min(f1) as lo, max(f1) as hi
  from k join s on s.fold <> k.fold group by k.fold)"""


@query("impute_fold", with_views("surveys", """
select s.id, s.fold, round(s.f1, 6) as f1, round(coalesce(s.f2, t.m2), 6) as f2 from s join t on s.fold = t.fold""", _STATS))
def impute_fold(spark, sf):
    return rounded(P.impute_out_of_fold(_folded(spark, sf).select("id", "fold", "f1", "f2"), "fold", ["f1", "f2"]), "f1", "f2")


@query("scale_fold", with_views("surveys", """
select s.id, s.fold, round((s.f1 - t.m1) / t.d1, 6) + 0.0 as f1, round((s.f2 - t.m2) / t.d2, 6) + 0.0 as f2 from s join t on s.fold = t.fold""", _STATS))
def scale_fold(spark, sf):
    return rounded(P.scale_out_of_fold(_folded(spark, sf).select("id", "fold", "f1", "f2"), "fold", ["f1", "f2"]), "f1", "f2")


@query("minmax_fold", with_views("surveys", """
select s.id, s.fold, round((s.f1 - t.lo) / (t.hi - t.lo) * 2 - 1, 6) + 0.0 as f1 from s join t on s.fold = t.fold""", _STATS))
def minmax_fold(spark, sf):
    df = _folded(spark, sf).select("id", "fold", "f1")
    return rounded(P.scale_out_of_fold(df, "fold", ["f1"], "min-max", -1.0, 1.0), "f1")


def _fit_rows(name: str, strategy: str, value: str):
    @query(name, with_views("surveys", f"""
select s.id, round(coalesce(s.f2, t.v), 6) as f2 from s, (select {value} as v from s where fold <> 1 {'and f2 is not null' if strategy == 'most_frequent' else ''}) t
where s.fold = 1""", "s as (select *, cast(snapshot_id % 5 + 1 as int) as fold from surveys)"))
    def run(spark, sf):
        df = _folded(spark, sf).select("id", "fold", "f2")
        model = P.TrainImputer(inputCols=["f2"], strategy=strategy)
        return rounded(P.fit_transform_rows(model, df, F.col("fold") != 1, F.col("fold") == 1).select("id", "f2"), "f2")


_fit_rows("impute_median", "median", "quantile_cont(f2, 0.5)")
_fit_rows("impute_mean", "mean", "avg(f2)")


@query("impute_mode", with_views("surveys", """
select s.id, round(coalesce(s.f2, t.f2), 6) as f2 from s, (select f2 from s where fold <> 1 and f2 is not null group by f2 order by count(*) desc, f2 limit 1) t
where s.fold = 1""", "s as (select *, cast(snapshot_id % 5 + 1 as int) as fold from surveys)"))
def impute_mode(spark, sf):
    df = _folded(spark, sf).select("id", "fold", "f2")
    model = P.TrainImputer(inputCols=["f2"], strategy="most_frequent")
    return rounded(P.fit_transform_rows(model, df, F.col("fold") != 1, F.col("fold") == 1).select("id", "f2"), "f2")


@query("label_encode", """
select c_custkey, cast(dense_rank() over (order by lower(c_mktsegment)) - 1 as int) as y, lower(c_mktsegment) as decoded,
  case when lower(c_mktsegment) = 'machinery' then 1 else 0 end as is_machinery from customer""")
def label_encode(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    classes = P.class_table(c, "c_mktsegment")
    out = P.decode_label(P.encode_label(c, "c_mktsegment", classes, "y"), "y", classes, "decoded")
    return P.one_vs_rest(out, "c_mktsegment", "MACHINERY", "is_machinery").drop("c_mktsegment")


_TYPES = ["click", "error", "purchase", "scroll", "view"]


@query("one_hot", "select event_id, " + ", ".join(f"case when event_type = '{t}' then 1 else 0 end as event_type_{t}" for t in _TYPES) + " from events")
def one_hot(spark, sf):
    return P.one_hot(load(spark, sf, "events").select("event_id", "event_type"), "event_type", _TYPES).drop("event_type")


@query("binarise_median", with_views("surveys", """
select s.id, s.snapshot_id, cast(s.f1 > g.m1 as int) as f1, cast(s.f2 > g.m2 as int) as f2
from surveys s join (select snapshot_id, quantile_cont(f1, 0.5) as m1, quantile_cont(f2, 0.5) as m2 from surveys group by snapshot_id) g
on s.snapshot_id = g.snapshot_id"""))
def binarise_median(spark, sf):
    return P.binarise_at_median(surveys(spark, sf).select("id", "snapshot_id", "f1", "f2"), ["f1", "f2"], "snapshot_id")


@query("binarise_train_median", with_views("surveys", """
select s.id, cast(s.f1 > g.m1 as int) as f1 from surveys s, (select quantile_cont(f1, 0.5) as m1 from surveys where snapshot_id % 5 <> 0) g
where s.snapshot_id % 5 = 0"""))
def binarise_train_median(spark, sf):
    df = _folded(spark, sf)
    train, test = df.filter("fold <> 1"), df.filter("fold = 1")
    return P.binarise_at_median(test.select("id", "f1"), ["f1"], fit_on=train)


@query("undersample", with_views("binary_scores", """
select id, truth from (select id, truth, row_number() over (partition by truth order by (id * 7919) % 10007, id) as k from binary_scores)
where k <= (select min(n) from (select count(*) as n from binary_scores group by truth))"""))
def undersample(spark, sf):
    df = binary_scores(spark, sf).select("id", "truth", ((F.col("id") * 7919) % 10007).alias("mix"))
    return P.undersample(df, "truth", "id", order=["mix"]).select("id", "truth")


@query("oversample", with_views("binary_scores", """
select r.id, r.truth, cast(c.k as int) as copy from
(select id, truth, row_number() over (partition by truth order by (id * 7919) % 10007, id) - 1 as pos, count(*) over (partition by truth) as n from binary_scores) r
join (select unnest(range((select count(*) from binary_scores))) as k) c
on r.pos + c.k * r.n < (select max(n) from (select count(*) as n from binary_scores group by truth))"""))
def oversample(spark, sf):
    df = binary_scores(spark, sf).select("id", "truth", ((F.col("id") * 7919) % 10007).alias("mix"))
    return P.oversample(df, "truth", "id", order=["mix"]).select("id", "truth", "copy")


@query("multilabel_targets", with_views("binary_scores", "select id, truth, truth2, truth + truth2 as labels_set from binary_scores"))
def multilabel_targets(spark, sf):
    df = P.multilabel_targets(binary_scores(spark, sf), ["truth", "truth2"])
    return df.select("id", F.get("targets", F.lit(0)).alias("truth"), F.get("targets", F.lit(1)).alias("truth2"),
                     F.aggregate("targets", F.lit(0), lambda a, b: a + b).alias("labels_set"))


_WINDOW = """w as (select id, snapshot_id, stress_d, f1, lag(f1, 1, 0) over o as p1, lag(f1, 2, 0) over o as p2,
  coalesce(f2, -1) as g, lag(coalesce(f2, -1), 1, 0) over o as g1, lag(coalesce(f2, -1), 2, 0) over o as g2
  from surveys window o as (partition by snapshot_id order by survey_start_datetime, id))"""


@query("windows3", with_views("surveys", """
select id, stress_d as label, round(p2, 6) as f1_0, round(p1, 6) as f1_1, round(f1, 6) as f1_2,
  round(g2, 6) as f2_0, round(g1, 6) as f2_1, round(g, 6) as f2_2 from w""", _WINDOW))
def windows3(spark, sf):
    df = surveys(spark, sf).withColumn("g", F.coalesce("f2", F.lit(-1.0)))
    seq = sequences_with_label(df, "id", ["snapshot_id"], ["survey_start_datetime", "id"], ["f1", "g"], "stress_d", 3)
    cells = [F.round(F.get(F.get("steps", F.lit(t)), F.lit(c)), 6).alias(f"f{c + 1}_{t}") for c in range(2) for t in range(3)]
    return seq.select("id", "label", *cells)


@query("seq_scale", with_views("surveys", """
select w.id, round((p2 - m) / s, 6) + 0.0 as s0, round((p1 - m) / s, 6) + 0.0 as s1, round((f1 - m) / s, 6) + 0.0 as s2
from w, (select avg(v) as m, stddev_pop(v) as s from (select p2 as v from w union all select p1 from w union all select f1 from w))""", _WINDOW))
def seq_scale(spark, sf):
    seq = sliding_windows(surveys(spark, sf), ["snapshot_id"], ["survey_start_datetime", "id"], ["f1"], 3).select("id", "steps")
    scaled = scale_sequences(seq, "steps")
    return scaled.select("id", *[(F.round(F.get(F.get("steps", F.lit(t)), F.lit(0)), 6) + 0.0).alias(f"s{t}") for t in range(3)])


@query("turn_windows", """
select conv_id, turn, len(text) as n2, lag(len(text), 1, 0) over (partition by conv_id order by turn) as n1 from conversations""")
def turn_windows(spark, sf):
    df = load(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    seq = sliding_windows(df, ["conv_id"], ["turn"], ["n"], 2)
    return seq.select("conv_id", "turn", F.get(F.get("steps", F.lit(1)), F.lit(0)).cast("long").alias("n2"), F.get(F.get("steps", F.lit(0)), F.lit(0)).cast("long").alias("n1"))


# --- text ----------------------------------------------------------------------

_SENTS = r"""ss as (select doc_id, unnest(regexp_split_to_array(trim(lower(text)), '[.!?]+(?:\s+|$)|\n+')) as s,
  generate_subscripts(regexp_split_to_array(trim(lower(text)), '[.!?]+(?:\s+|$)|\n+'), 1) as sent from documents),
sw as (select doc_id, sent, list_filter(regexp_extract_all(s, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}+')) as words from ss where len(s) > 0),
st as (select * from sw where len(words) > 0)"""

_TOK = _SENTS + """,
tk as (select doc_id, unnest(words) as word from st)"""


@query("tokens", with_views("", "select word, count(*) as n, count(distinct doc_id) as docs from tk group by word", _TOK))
def tokens(spark, sf):
    sents = X.sentence_table(load(spark, sf, "documents"), "doc_id", "text")
    per_doc = sents.select("doc_id", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("pmi_vocab", with_views("", """
select word as ngram, 1 as n, c, cast(null as double) as pmi from u
union all select ngram, 2, c, round(pmi, 6) from (select b.ngram, b.c, log2(b.c) + log2((select sum(c) from u)) - log2(u1.c) - log2(u2.c) as pmi
  from b join u u1 on u1.word = b.w1 join u u2 on u2.word = b.w2) where pmi > 2.0
union all select ngram, 3, c, round(pmi, 6) from (select t.ngram, t.c, log2(t.c) + 2 * log2((select sum(c) from u)) - log2(u1.c) - log2(u2.c) - log2(u3.c) as pmi
  from t join u u1 on u1.word = t.w1 join u u2 on u2.word = t.w2 join u u3 on u3.word = t.w3) where pmi > 2.0
union all select ngram, 4, c, round(pmi, 6) from (select q.ngram, q.c, log2(q.c) + 3 * log2((select sum(c) from u)) - log2(u1.c) - log2(u2.c) - log2(u3.c) - log2(u4.c) as pmi
  from q join u u1 on u1.word = q.w1 join u u2 on u2.word = q.w2 join u u3 on u3.word = q.w3 join u u4 on u4.word = q.w4) where pmi > 2.0""", _TOK + """,
u as (select word, count(*) as c from tk group by word),
b as (select w1 || ' ' || w2 as ngram, w1, w2, count(*) as c from (select words[i] as w1, words[i + 1] as w2 from
  (select words, unnest(range(1, len(words))) as i from st)) group by w1, w2),
t as (select w1 || ' ' || w2 || ' ' || w3 as ngram, w1, w2, w3, count(*) as c from (select words[i] as w1, words[i + 1] as w2, words[i + 2] as w3 from
  (select words, unnest(range(1, len(words) - 1)) as i from st)) group by w1, w2, w3),
q as (select w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 as ngram, w1, w2, w3, w4, count(*) as c from (select words[i] as w1, words[i + 1] as w2, words[i + 2] as w3, words[i + 3] as w4 from
  (select words, unnest(range(1, len(words) - 2)) as i from st)) group by w1, w2, w3, w4)"""))
def pmi_vocab(spark, sf):
    return rounded(X.pmi_vocabulary(load(spark, sf, "documents"), "doc_id", "text", 1, 4), "pmi")


@query("tfidf", with_views("", """
select doc_id, word as term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from
(select f.doc_id, f.word, f.tf * (ln((1.0 + n) / (1.0 + d.df)) + 1) as w from f join d on f.word = d.word, (select count(*) as n from documents)
 where d.df >= 0.01 * n and d.df <= n)""", _TOK + """,
f as (select doc_id, word, count(*) as tf from tk group by doc_id, word),
d as (select word, count(*) as df from f group by word)"""))
def tfidf(spark, sf):
    return rounded(X.tfidf(load(spark, sf, "documents"), "doc_id", "text", min_df=0.01, max_df=1.0), "weight")


@query("tfidf_turns", with_views("", """
select id, word as term, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from
(select f.id, f.word, f.tf * (ln((1.0 + n) / (1.0 + d.df)) + 1) as w from f join d on f.word = d.word, (select count(*) as n from conversations) where d.df >= 2)""",
r"""ss as (select conv_id * 1000 + turn as id, unnest(regexp_split_to_array(trim(lower(text)), '[.!?]+(?:\s+|$)|\n+')) as s from conversations),
tk as (select id, unnest(list_filter(regexp_extract_all(s, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}+'))) as word from ss),
f as (select id, word, count(*) as tf from tk group by id, word),
d as (select word, count(*) as df from f group by word)"""))
def tfidf_turns(spark, sf):
    """Per-step text vectors: every turn is one step of its conversation."""
    turns = load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rounded(X.tfidf(turns, "id", "text", min_df=2), "weight")


_INDEX = r"""tk as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word,
  generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) as pos from documents),
ix as (select word, c, cast(row_number() over (order by c desc, word) as int) as idx from (select word, count(*) as c from tk group by word))"""


@query("word_index", with_views("", "select word, c, idx from ix", _INDEX))
def word_index(spark, sf):
    return X.word_index(load(spark, sf, "documents"), "text", None)


@query("word_ids", with_views("", "select d.doc_id, " + ", ".join(f"coalesce(max(case when k = {i + 1} then idx end), 0) as id_{i}" for i in range(12)) + """
from documents d left join (select doc_id, idx, row_number() over (partition by doc_id order by pos) as k from tk join ix on tk.word = ix.word) t
on d.doc_id = t.doc_id group by d.doc_id""", _INDEX))
def word_ids(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    ids = X.word_id_sequences(docs, "doc_id", "text", X.word_index(docs, "text", None), 12, complete=True)
    return ids.select("doc_id", *[F.get("ids", F.lit(i)).alias(f"id_{i}") for i in range(12)])


@query("word_vectors", with_views("", """
select ix.word, ix.idx, """ + ", ".join(f"coalesce(cast(e.embedding[{i + 1}] as double), 0.0) as v_{i}" for i in range(64)) + """
from ix left join embeddings e on e.vec_id = ix.idx""", _INDEX))
def word_vectors(spark, sf):
    index = X.word_index(load(spark, sf, "documents"), "text", None).select("word", "idx", F.col("idx").cast("long").alias("vec"))
    vectors = load(spark, sf, "embeddings").select("vec_id", "embedding")
    out = X.word_vectors(index, "vec", vectors, "vec_id", "embedding", 64)
    return out.select("word", "idx", *[F.get("vector", F.lit(i)).alias(f"v_{i}") for i in range(64)])
