"""Registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortline.llm import (
    ann, decontamination, html_extract, manifest, ngram_join, packing, periodic_runs, secret_scan, sharding, toxicity, url_filter,
    vector_packing, warc,
)
from cohortline.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(load(spark, sf_dir, "documents"), shards=40)


@query
def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SQL["op3_decontamination"] = r"""
with d as (
  select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
b as (
  select item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
g as (
  select distinct item_id, least(len(w), 10) as span, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
p as (
  select r, span, i, array_to_string(w[i:i + span - 1], ' ') as gram
  from (select r, w, span, unnest(range(1, len(w) - span + 2)) as i from d, (select distinct span from g) where len(w) >= span)),
h as (select p.r, p.i, p.span, g.item_id from p join g on p.span = g.span and p.gram = g.gram),
n as (select r, count(distinct k) as n_hit from (select distinct r, unnest(range(i, i + span)) as k from h) group by r),
m as (
  select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from h group by r)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join m using (r)
"""


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(load(spark, sf_dir, "documents"))


SQL["op7_secret_scan"] = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
k as (select * from (values (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'key'), (4, 'endpoint')) as v(kind, name)),
m as (
  select r, 0 as kind, regexp_split_to_array(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as gaps,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as hits from d
  union all select r, 1, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') from d
  union all select r, 2, regexp_split_to_array(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') from d
  union all select r, 3, regexp_split_to_array(t, '[A-Za-z0-9+/]{32,}'), regexp_extract_all(t, '[A-Za-z0-9+/]{32,}') from d
  union all select r, 4, regexp_split_to_array(t, 'https?://[^\x00-\x20"''<>]+'), regexp_extract_all(t, 'https?://[^\x00-\x20"''<>]+') from d),
u as (select r, kind, unnest(range(1, len(hits) + 1)) as i, gaps, hits from m),
l as (select r, kind, i, length(gaps[i]) as gap, hits[i] as hit from u),
p as (
  select r, kind, hit, sum(gap + length(hit)) over (partition by r, kind order by i) - length(hit) as s,
    sum(gap + length(hit)) over (partition by r, kind order by i) as e from l),
f as (
  select * from p
  where case kind
    when 0 then length(regexp_extract(hit, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 6
    when 1 then length(hit) >= 20
    when 3 then regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Z]') and regexp_matches(hit, '[a-z]')
    else true end),
x as (
  select r, kind, s, e from f where kind <= 2
  union all
  select w.r, w.kind, w.s, w.e from f w join f o on w.r = o.r and abs(w.s - o.s) <= 400 and o.kind <= 3 where w.kind >= 3
  group by w.r, w.kind, w.s, w.e
  having bool_or(o.kind = 1) and (w.kind = 3 or bool_or(o.kind <> 1))),
g as (
  select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    count(*) filter (kind = 3) as n_key, count(*) filter (kind = 4) as n_endpoint,
    string_agg(name || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, kind) filter (kind <= 2) as base,
    string_agg(name || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, kind) as spans
  from x join k using (kind) group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_key, 0) as n_key, coalesce(n_endpoint, 0) as n_endpoint
from d left join g using (r)
"""


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of the derived records of all pages; the blocks themselves are reported by digest and length."""
    return warc.derive(warc.responses(load(spark, sf_dir, "pages"))).drop("block")


SQL["op5_warc"] = r"""
with s as (select page_id, coalesce(url, '') as uri, coalesce(html, '') as payload from pages),
r as (
  select *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: '
      || octet_length(encode(payload)) || chr(13) || chr(10) || chr(13) || chr(10) as source_headers,
    'sha1:' || sha1(payload) as source_digest,
    md5('response' || chr(10) || coalesce(cast(page_id as varchar), '') || chr(10) || uri || chr(10) || 'sha1:' || sha1(payload)) as h
  from s),
t1 as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload,
      '(?is)<!--.*?(?:-->|\z)|<(?:script|style|noscript|template|head)(?:\s[^>]*)?>.*?(?:</(?:script|style|noscript|template|head)\s*>|\z)', ' ', 'g'),
      '[\r\n\t ]+', ' ', 'g'),
      '(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|blockquote|pre|form)(?:[\s/][^>]*)?>', chr(10), 'g'),
      '(?s)</?[a-zA-Z][^>]*(?:>|\z)|<![^>]*(?:>|\z)', '', 'g') as t
  from r),
t2 as (
  select * exclude (t), replace(replace(replace(replace(replace(replace(replace(replace(t,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as t
  from t1),
t3 as (
  select * exclude (t), regexp_replace(regexp_replace(regexp_replace(t, '[ ]+', ' ', 'g'), '[ ]*\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g') as t
  from t2),
b as (
  select *, 'metadata' as record_type, 'application/warc-fields' as content_type,
    'source-digest: ' || source_digest || chr(13) || chr(10) || 'source-content-length: ' || octet_length(encode(payload)) || chr(13) || chr(10)
      || 'text-length: ' || length(t) || chr(13) || chr(10) as block
  from t3
  union all
  select *, 'conversion', 'text/plain; charset=utf-8', t from t3),
u as (
  select *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' as refers_to from b),
v as (select *, md5(record_type || chr(10) || refers_to) as g from u)
select page_id, record_type, '<urn:uuid:' || g[1:8] || '-' || g[9:12] || '-' || g[13:16] || '-' || g[17:20] || '-' || g[21:32] || '>' as record_id,
  refers_to, uri as target_uri, content_type, source_headers, source_digest, 'sha1:' || sha1(block) as block_digest,
  case when record_type = 'conversion' then 'sha1:' || sha1(block) end as payload_digest, octet_length(encode(block)) as content_length
from v
"""


@query
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


@query
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(load(spark, sf_dir, "embeddings"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return periodic_runs.digest(periodic_runs.find(periodic_runs.planted(docs)))


#: crc32 of a string of ASCII digits, bit by bit: each byte is followed by its eight shifts (-1).
_CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(
  string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end), 4294967295::bigint)"""

SQL["op11_periodic_runs"] = r"""
with d as (
  select row_number() over () as r, doc_id, CRC as h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
e as (select *, h // 10 as g, len(w) as n from d),
f as (
  select r, doc_id, w, n, case when h % 10 = 0 and n > 0 then g % n end as a,
    case when h % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from e),
t as (
  select r, doc_id, n,
    case when a is null then w else list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) end as w
  from f),
-- 16 equal words in a row hold 8 equal ones that begin at a multiple of 8, so these pairs show every lag of a run
k as (select r, n, i, array_to_string(w[i + 1:i + 8], ' ') as gram from (select r, n, w, unnest(range(0, n - 7)) as i from t where n >= 24)),
lags as (select distinct x.r, y.i - x.i as q from k x join k y on x.r = y.r and x.gram = y.gram and x.i % 8 = 0 and y.i > x.i and 3 * (y.i - x.i) <= x.n),
m as (
  select r, q, i from (select t.r, t.n, q, t.w, unnest(range(0, t.n - q)) as i from lags join t using (r))
  where w[i + 1] = w[i + q + 1]),
s as (
  select r, q, min(i) as start, count(*) + q as length
  from (select r, q, i, i - row_number() over (partition by r, q order by i) as island from m) group by r, q, island),
u as (select r, start, length, min(q) as period from s group by r, start, length having length >= greatest(24, 3 * min(q))),
best as (
  select r, start, length, period from u
  qualify row_number() over (partition by r order by cast(length as double) / period desc, start, period) = 1),
lines as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as x from u group by r),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from u),
kept as (
  select v.r, string_agg(v.x, ' ' order by v.i) as x
  from (select r, unnest(range(0, n)) as i, unnest(w) as x from t) v anti join gone using (r, i) group by v.r)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(lines.x, '')) as runs_sha256, sha256(coalesce(kept.x, '')) as collapsed_sha256
from t left join lines using (r) left join best using (r) left join kept using (r)
""".replace("CRC", _CRC32)


@query
def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered(load(spark, sf_dir, "documents"))


SQL["op13_merkle_manifest"] = r"""
with recursive d as (
  select row_number() over () as r, doc_id, source, CRC as h, coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-') as head, text from documents),
l as (
  select r, doc_id, source, h, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) as low
  from d),
o as (
  select r, doc_id, leaf, case when h % 5 = 0 then low else leaf end as seen, dense_rank() over (order by source nulls first) - 1 as s,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n
  from l),
up(s, level, i, n, x) as (
  select s, 0, i, n, leaf from o
  union all
  select distinct s, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(x, '') over (partition by s, i // 16 order by i rows between unbounded preceding and unbounded following))
  from up where n > 1),
sub as (select s, x as subroot, level as height, count(*) over () as n from up where n = 1),
top(level, i, n, x) as (
  select 0, s, n, subroot from sub
  union all
  select distinct level + 1, i // 16, (n + 15) // 16, sha256(string_agg(x, '') over (partition by i // 16 order by i rows between unbounded preceding and unbounded following))
  from top where n > 1),
nodes as (
  select s, level, i, n, x from up
  union all
  select sub.s, sub.height + t.level, t.i, t.n, t.x from top t, sub where t.n > 1 or t.level > 0),
-- the leaf's node on each level: its own tree's, from the subroot on the top tree's
mine as (
  select o.r, o.s, k.level, o.i // cast(power(16, k.level) as bigint) as i from o join sub using (s), lateral (select unnest(range(0, sub.height)) as level) k
  union all
  select o.r, o.s, sub.height + k.level, o.s // cast(power(16, k.level) as bigint)
  from o join sub using (s), lateral (select unnest(range(0, (select max(level) from top))) as level) k),
path as (
  select m.r, m.level, coalesce(string_agg(b.x, '' order by b.i) filter (b.i < m.i), '') as before,
    coalesce(string_agg(b.x, '' order by b.i) filter (b.i > m.i), '') as behind
  from mine m join nodes b on b.s = m.s and b.level = m.level and b.n > 1 and b.i // 16 = m.i // 16 group by m.r, m.level, m.i),
fold(r, level, x) as (
  select r, 0, seen from o
  union all
  select f.r, f.level + 1, sha256(p.before || f.x || p.behind) from fold f join path p on p.r = f.r and p.level = f.level),
proof as (select r, string_agg(before || behind, '' order by level) as x from path group by r)
select o.doc_id, o.leaf, sub.subroot, (select x from top where n = 1) as root, sha256(coalesce(proof.x, '')) as proof_sha256,
  f.x as folded_root, f.x = (select x from top where n = 1) as verified
from o join sub using (s) left join proof using (r)
  join (select r, x from fold qualify row_number() over (partition by r order by level desc) = 1) f using (r)
""".replace("CRC", _CRC32)
