"""Queries of the training-data operators over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, divergence, exact_dedup, hard_negatives, langid, line_dedup, mixing, sentence_dedup, simhash, suffix_dedup, topk, toxicity

DIMS = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.dedup_runs(_table(spark, sf_dir, "documents"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), DIMS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    out = index.add(_table(spark, sf_dir, "documents"))
    index.drop()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).drop("exact")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_toxicity,
            op2_simhash,
            op3_language_id,
            op4_sentence_spans,
            op5_line_windows,
            op6_top_k,
            op7_mixing,
            op8_suffix_array,
            op9_exact_dedup,
            op10_byte_bpe,
            op11_source_divergence,
            op12_decontaminate,
            op13_hard_negatives,
        )
    }


OP5_SQL = """
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
x as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from l),
w as (
  select doc_id, pos, line, lead(line, 1) over d as l1, lead(line, 2) over d as l2, count(*) over (partition by doc_id) as n
  from x window d as (partition by doc_id order by pos)),
r as (
  select doc_id, pos from (
    select doc_id, pos, row_number() over (partition by line, l1, l2 order by doc_id, pos) as k from w where pos + 3 <= n) t
  where k > 1),
starts as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from r),
spans as (select doc_id, count(*) as n_spans from starts where before is null or pos > before + 3 group by doc_id),
gone as (select distinct doc_id, pos + k as pos from r, (values (0), (1), (2)) v(k)),
kept as (
  select x.doc_id, count(*) as n, string_agg(x.line, chr(10) order by x.pos) as t
  from x left join gone g on g.doc_id = x.doc_id and g.pos = x.pos where g.pos is null group by x.doc_id)
select l.doc_id, cast(len(l.ls) as bigint) as n_lines, cast(len(l.ls) - coalesce(k.n, 0) as bigint) as n_removed,
  cast(coalesce(s.n_spans, 0) as bigint) as n_spans, coalesce(k.t, '') as kept_text
from l left join kept k on k.doc_id = l.doc_id left join spans s on s.doc_id = l.doc_id
"""

OP6_SQL = """
with v as (select vec_id, embedding, list_transform(embedding, lambda x: x > 0) as b from embeddings where vec_id is not null and len(embedding) = 64),
d as (
  select q.vec_id as query_id, v.vec_id,
    cast(list_sum(list_transform(range(1, 65), lambda i: case when q.b[i] = v.b[i] then 0 else 1 end)) as int) as distance
  from v q, v where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)
select query_id, cast(rank as int) as rank, vec_id, distance from (
  select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) t
where rank <= 10
"""

OP7_SQL = r"""
with d as (
  select doc_id, source, cast(case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as bigint) as size,
    md5('17:' || coalesce(cast(doc_id as varchar), 'null')) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from s),
o as (
  select *, 2.0::double * source_size / weight as ratio, sum(source_size) over () * 1.5::double as total,
    coalesce(sum(2 * source_size) over (order by 2.0::double * source_size / weight, source rows between unbounded preceding and 1 preceding), 0)::double as capped,
    sum(weight) over (order by 2.0::double * source_size / weight desc, source desc) as open_weight
  from w),
f as (
  select min((total - capped)) filter (where (total - capped) * weight / open_weight <= 2.0::double * source_size) as dummy,
    arg_min(total - capped, ratio) filter (where (total - capped) * weight / open_weight <= 2.0::double * source_size) as spare,
    arg_min(open_weight, ratio) filter (where (total - capped) * weight / open_weight <= 2.0::double * source_size) as open_w
  from o),
t as (
  select source, source_size, case when f.spare is null or f.spare * weight / f.open_w > 2.0::double * source_size then 2.0::double * source_size
    else f.spare * weight / f.open_w end as target
  from w, f),
x as (
  select d.doc_id, d.size, t.source_size, t.target, cast(case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as bigint) as whole,
    coalesce(sum(d.size) over (partition by d.source order by d.h, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(whole * size + greatest(0, least(size, cast(round(target) as bigint) - whole * source_size - before)) as bigint) as taken
from x
"""

OP9_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""

OP11_SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
g as (select distinct lang, source from d),
kept as (select lang, term from (select lang, unnest(list_distinct(w)) as term from d) t group by lang, term having count(*) >= 30),
c as (select t.lang, t.source, t.term, count(*) as n from (select lang, source, unnest(w) as term from d) t join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
n as (select lang, source, sum(n) as total from c group by lang, source),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (coalesce(n.total, 0) + 5 * v.v) as p
  from g join kept k on k.lang = g.lang join v on v.lang = g.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join n on n.lang = g.lang and n.source = g.source),
q as (
  select c.lang, term, 1 + 1000000000::hugeint * (sum(n) + 5) // (t.total + 5 * v.v) as q
  from c join v on v.lang = c.lang join (select lang, sum(n) as total from c group by lang) t on t.lang = c.lang
  group by c.lang, term, t.total, v.v),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select s.lang, s.source, r.source as item, sum(abs(s.p - r.p)) as value from p s join p r on r.lang = s.lang and r.term = s.term and r.source <> s.source
             group by all) x
    on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select p.lang, p.source, p.term as item, p.p - q.q as value from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms) t
where part = 'pair' or rank <= 50
"""

OP12_SQL = r"""
with b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
i as (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as pos from b where len(w) > 0),
k as (select distinct item_id, n, array_to_string(w[pos:pos + n - 1], ' ') as s from i),
d as (
  select doc_id, case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') end as w
  from documents),
p as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as pos from d, (select distinct n from k) l),
h as (select distinct doc_id, n, pos, item_id from (select doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') as s from p) x join k using (n, s)),
c as (select doc_id, count(distinct pos + j) as n_hit from (select doc_id, pos, unnest(range(0, n)) as j from h) t group by doc_id),
o as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) t
  group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join c on c.doc_id = d.doc_id left join o on o.doc_id = d.doc_id
"""

OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, v.vec_id, a.label = v.label as own, cast(list_inner_product(a.e, v.e) as bigint) as score
  from v a, v where a.vec_id % 50 = 0 and v.vec_id <> a.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where own) t
  where k <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.own and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score) t
where rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_windows": OP5_SQL, "op6_top_k": OP6_SQL, "op7_mixing": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_hard_negatives": OP13_SQL}
