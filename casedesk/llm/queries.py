"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from casedesk.llm import (
    exact, html_text, jaccard, merkle, mixing, negatives, packing, secrets, substrings, toxicity,
    url_rules, vectors, warc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        F.col("record_id").alias("page_id"), "payload_bytes",
        F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judged(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, index).drop("evidence")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *packing.public_vocabulary())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").select(
        vec_id, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        "embedding")
    return negatives.hard_negatives(rows, anchors=vec_id % 100 == 0)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return merkle.verified(table(spark, sf_dir, "documents"), tampered=mark % 2 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_html_text, op3_substring_dedup, op4_url_filter, op5_toxicity, op6_jaccard_join, op7_mix_sources, op8_exact_dedup,
             op9_vector_dedup, op10_best_fit_packing, op11_hard_negatives, op12_secrets,
             op13_merkle_manifest)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_url_filter": OP4_SQL, "op8_exact_dedup": OP8_SQL,
            "op11_hard_negatives": OP11_SQL, "op12_secrets": OP12_SQL,
            "op13_merkle_manifest": OP13_SQL}


OP1_SQL = r"""
with rows as (
  select page_id, encode(coalesce(html, '')) as payload from pages),
hashed as (
  select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest
  from rows),
owned as (
  select *, min(page_id) over (partition by payload_digest) as first_id from hashed)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id is distinct from first_id then 'revisit'
            else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id is distinct from first_id then first_id
       end as refers_to
from owned
"""

OP4_SQL = r"""
with parts as (
  select page_id, coalesce(substr(url, nullif(instr(url, '://'), 0) + 3), '') as rest from pages),
split as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
rules as (
  select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
    as t(rule_host, rule_path, verdict)),
named as (
  select s.page_id, s.host, s.path,
         (select first(r.rule_host || r.rule_path || ' ' || r.verdict
                       order by length(r.rule_host || r.rule_path) desc)
          from rules r
          where (s.host = r.rule_host or ends_with(s.host, '.' || r.rule_host))
            and starts_with(s.path, r.rule_path)) as best
  from split s)
select page_id, host, path, split_part(best, ' ', 1) as rule,
       case when best is not null then split_part(best, ' ', 2)
            when regexp_matches(lower(host || path),
              '(^|[^a-z0-9])(adult|xxx|porn|escort|casino|poker|betting|free-bets|cheap-pills|' ||
              'viagra|payday-loan|spam-farm|link-farm|ads-track|adserver|torrent|warez|replica-watches)([^a-z0-9]|$)')
            then 'block' else 'allow' end as verdict
from named
"""

OP8_SQL = r"""
with rows as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
  from documents),
ranked as (
  select *, row_number() over (partition by body order by points desc, doc_id nulls last) as place
  from rows),
groups as (
  select body, count(*) as group_size,
         first(doc_id order by points desc, doc_id nulls last) as keep_id
  from rows group by body)
select r.doc_id, g.keep_id, g.group_size, r.place = 1 as kept, sha256(r.body) as text_sha256
from ranked r join groups g using (body)
"""

OP11_SQL = r"""
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other_id,
         cast(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)
              as bigint) as score
  from usable a, usable b
  where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id
                               order by s.score desc, s.other_id) as integer) as rank,
       s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
where 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
qualify rank <= 10
"""

OP12_SQL = r"""
with kinds as (
  select * from (values
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12),
    (1, 'access', '((AKIA[A-Z0-9]+))', 18),
    (2, 'hex', '(([0-9a-f]+))', 16)) as t(nr, kind, pattern, least)),
cut as (
  select doc_id, nr, kind, least,
         case nr when 0 then regexp_extract_all(text, (select pattern from kinds where nr = 0), 0)
                 when 1 then regexp_extract_all(text, (select pattern from kinds where nr = 1), 0)
                 else regexp_extract_all(text, (select pattern from kinds where nr = 2), 0) end as hits,
         case nr when 0 then regexp_extract_all(text, (select pattern from kinds where nr = 0), 2)
                 when 1 then regexp_extract_all(text, (select pattern from kinds where nr = 1), 2)
                 else regexp_extract_all(text, (select pattern from kinds where nr = 2), 2) end as bodies,
         case nr when 0 then regexp_split_to_array(text, (select pattern from kinds where nr = 0))
                 when 1 then regexp_split_to_array(text, (select pattern from kinds where nr = 1))
                 else regexp_split_to_array(text, (select pattern from kinds where nr = 2)) end as gaps
  from documents, kinds),
each as (
  select doc_id, nr, kind, least, unnest(range(1, len(hits) + 1)) as i, unnest(hits) as hit,
         unnest(bodies) as body, unnest(gaps[1:len(hits)]) as gap from cut),
placed as (
  select doc_id, nr, kind, least, hit, body,
         sum(length(gap)) over w + sum(length(hit)) over w as stop from each
  window w as (partition by doc_id, nr order by i)),
spans as (
  select doc_id, nr, cast(stop - length(hit) as bigint) as start,
         kind || ':' || cast(stop - length(hit) as bigint) || ':' || cast(stop as bigint) as span
  from placed where length(body) >= least),
listed as (
  select doc_id, count(*) filter (nr = 0) as n_assign, count(*) filter (nr = 1) as n_access,
         count(*) filter (nr = 2) as n_hex, string_agg(span, ',' order by start, nr) as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
       coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256,
       coalesce(spans, '') as spans
from documents d left join listed l using (doc_id)
"""

OP13_SQL = r"""
with recursive
parted as (
  select *, cast(doc_id as varchar) as name,
         coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head
  from documents),
marked as (  -- the CRC-32 bit by bit: a step for each bit of each byte
  select *, coalesce(xor(list_reduce(list_concat([4294967295], flatten(list_transform(
      range(1, length(name) + 1), lambda i: [cast(ascii(name[i]) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295) % 2 = 0, false)
    as tampered
  from parted),
hashed as (
  select doc_id, coalesce('+' || source, '!') as grp,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         case when tampered then
           sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
         else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as claimed
  from marked),
leaves as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos,
         count(*) over (partition by grp) as n
  from hashed),
nodes as (
  select grp, 0 as level, pos, n, leaf as digest from leaves
  union all
  select grp, level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' order by pos))
  from nodes where n > 1 group by grp, level, pos // 3),
subroots as (
  select grp, digest, row_number() over (order by grp) - 1 as pos, count(*) over () as n
  from nodes where n = 1),
top_nodes as (
  select 0 as level, pos, n, digest from subroots
  union all
  select level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' order by pos))
  from top_nodes where n > 1 group by level, pos // 3),
steps as (
  select grp, level, pos,
         coalesce(string_agg(digest, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
         coalesce(string_agg(digest, '') over (w rows between 1 following and unbounded following), '') as after
  from nodes where n > 1 window w as (partition by grp, level, pos // 3 order by pos)),
top_steps as (
  select level, pos,
         coalesce(string_agg(digest, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
         coalesce(string_agg(digest, '') over (w rows between 1 following and unbounded following), '') as after
  from top_nodes where n > 1 window w as (partition by level, pos // 3 order by pos)),
folds as (
  select grp, pos as leaf_pos, 0 as level, pos, n, claimed as digest, '' as proof from leaves
  union all
  select f.grp, f.leaf_pos, f.level + 1, f.pos // 3, (f.n + 2) // 3,
         sha256(s.before || f.digest || s.after), f.proof || s.before || s.after
  from folds f join steps s on f.grp = s.grp and f.level = s.level and f.pos = s.pos
  where f.n > 1),
top_folds as (
  select f.grp, f.leaf_pos, 0 as level, r.pos, r.n, f.digest, f.proof
  from folds f join subroots r on f.grp = r.grp where f.n = 1
  union all
  select f.grp, f.leaf_pos, f.level + 1, f.pos // 3, (f.n + 2) // 3,
         sha256(s.before || f.digest || s.after), f.proof || s.before || s.after
  from top_folds f join top_steps s on f.level = s.level and f.pos = s.pos
  where f.n > 1)
select l.doc_id, l.leaf, r.digest as subroot, t.digest as root, sha256(f.proof) as proof_sha256,
       f.digest as folded_root, f.digest = t.digest as verified
from leaves l join subroots r on l.grp = r.grp
  join top_folds f on f.grp = l.grp and f.leaf_pos = l.pos and f.n = 1
  cross join (select digest from top_nodes where n = 1) t
"""
