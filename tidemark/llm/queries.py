"""One query for each training-data operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, line_dedup, quality, simhash, token_counts, toxicity, vectors, warc
from .common import scratch_path, table

#: Where the public tokenizers' files are; a parameter of the queries, never copied.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.audited(table(spark, sf_dir, "embeddings")).drop("n_distinct")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", keep=["doc_id"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "n_removed")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.pages(warc.read(files))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "evidence", "host_quality", "path_quality", "quality_prob", "accepted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "cut_repeated", "cut_structure")


QUERIES = {f.__name__: f for f in (op1_vector_dedup, op2_toxicity, op3_token_counts, op4_line_dedup, op5_decontaminate, op6_warc, op7_simhash, op8_quality, op9_bpe, op10_html)}

#: What SQL can say: brute force over all pairs, windows or lines. Trained models, XXH64, vocabularies
#: and markup are tested against plain versions instead.
ORACLE_SQL: dict[str, str] = {
    "op1_vector_dedup": """
with recursive v as (
  select distinct vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, other) as (select vec_id, vec_id from v union select r.id, p.b from r join p on p.a = r.other),
c as (select id, min(other) as component_id from r group by id), n as (select a, count(distinct b) as n from p group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.component_id, e.vec_id) as component_id, e.vec_id = coalesce(c.component_id, e.vec_id) as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.id = e.vec_id""",
    "op4_line_dedup": """
with docs as (select doc_id, text, n_chars, coalesce(doc_id::varchar, 'null') || ':' || coalesce(md5(text), '-') as k from documents),
lines as (select k, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from docs
  where contains(text, chr(10)) or len(string_split(text, ' ')) >= 50),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h, len(string_split(line, ' ')) as w from lines),
g as (select *, lead(h, 1, 0) over d as nh, lag(h, 1, 0) over d as ph, lag(h, 2, 0) over d as p2, coalesce(lag(w) over d, 0) as pw from h window d as (partition by k order by i)),
b as (select g.*, c, i = 0 or w >= 50 or pw >= 50 or ((case when ahead then h * mul + nh + ad else p2 * mul + ph + ad end) >> 16) & 1 = 1 as s
  from g, (values (0, true, 31, 1), (1, true, 1009, 7), (2, false, 31, 3), (3, false, 1009, 11)) t(c, ahead, mul, ad)),
m as (select *, sum(s::int) over (partition by k, c order by i) as chunk from b),
ch as (select k, doc_id, min(i) as pos, count(*) as n, sum(w) as w, string_agg(line, chr(10) order by i) as body from m group by k, doc_id, c, chunk),
sp as (select distinct k, doc_id, pos, n, body from ch where (n >= 2 or w >= 50) and w >= 8),
f as (select *, first_value(k) over o as fk, first_value(pos) over o as fp from sp window o as (partition by body order by doc_id is null, doc_id, k, pos)),
nw as (select k, doc_id, line, i, len(list_filter(string_split(line, ' '), lambda x: x <> '')) as n from lines),
ce as (select *, sum(n) over (partition by k order by i) as e from nw), cs as (select *, e - n as s from ce),
ww as (select a.k, a.i as lo, b.i as hi from cs a join cs b on a.k = b.k and b.s <= a.s + 50 and a.s + 50 < b.e where a.n > 0
  union select a.k, b.i, a.i from cs a join cs b on a.k = b.k and b.s <= a.e - 51 and a.e - 51 < b.e where a.n > 0),
wt as (select w.k, l.doc_id, lo, hi - lo + 1 as n, string_agg(l.line, chr(10) order by l.i) as body from ww w join lines l on l.k = w.k and l.i between lo and hi where hi > lo group by w.k, l.doc_id, lo, hi),
wf as (select *, first_value(k) over o as fk, first_value(lo) over o as fp from wt window o as (partition by body order by doc_id is null, doc_id, k, lo)),
gone as (select distinct k, i from (select k, unnest(range(pos, pos + n)) as i from f where k <> fk or pos <> fp union all select k, unnest(range(lo, lo + n)) from wf where k <> fk or lo >= fp + n)),
rest as (select l.k, string_agg(l.line, chr(10) order by l.i) as body from lines l left join gone using (k, i) where gone.i is null group by l.k),
cnt as (select k, count(*) as n from gone group by k)
select d.doc_id, case when cnt.n > 0 then coalesce(rest.body, '') else d.text end as text, case when cnt.n > 0 then length(coalesce(rest.body, '')) else d.n_chars end as n_chars, coalesce(cnt.n, 0)::bigint as n_removed
from docs d left join cnt using (k) left join rest using (k)""",
    "op5_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
k as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as span from (select *, least(len(w), 10) as n from t) where n > 0),
s as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, (select distinct n from k) where len(w) >= n),
hit as (select s.doc_id, s.i, s.n, k.item_id from s join k on k.n = s.n and k.span = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
p as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(i, i + n)) as q from hit) group by doc_id),
m as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(p.n_hit, 0)::bigint as n_hit, coalesce(m.n_items, 0)::bigint as n_items, sha256(coalesce(m.ids, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join m using (doc_id)""",
    "op6_warc": """
with p as (select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as f from pages)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(html), (i // 4)::int * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to from p""",
}
