"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import best_fit, causal_lm, compression_rules, hard_negatives, jaccard_join, jump_shards, language_id, passages, personal_data, piece_scan, sparse_topk, target_resampling, toxicity
from .common import table

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return register


@query("op1_sparse_topk", """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as w
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.w, c.w, true), lambda z: z[1] * z[2])), 0) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id
  where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 10""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return sparse_topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


@query("op2_compression_bands")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.quality(table(spark, sf_dir, "documents"))


@query("op6_jump_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.shard(table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_hashed_subwords")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op8_ngram_jaccard", r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), ngrams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from docs
), sizes as (select doc_id, count(*) as n from ngrams group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as o from ngrams a join ngrams b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select x, y from shared join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * o >= 80 * (s.n + t.n - o)
), both_ways as (select x, y from links union all select y, x from links),
reached(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, b.y from reached r join both_ways b on r.other = b.x
), least as (select doc_id, min(other) as component_id from reached group by doc_id)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, l.component_id
from documents d left join sizes s on s.doc_id = d.doc_id join least l on l.doc_id = d.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op5_collinear_passages")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op10_skip_chain_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


@query("op9_causal_attention")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_max_plus_pieces")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_scan.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


@query("op11_position_crc_resampling", r"""
with crc_table as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t
), texts as (
  select doc_id, true as own, text from documents union all select null, false, text from benchmark
), words as (
  select row_number() over () as place, doc_id, own, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts
), features as (select place, own, unnest(w) as f from words),
bytes as (
  select f, list_transform(range(1, octet_length(encode(f)) + 1), lambda i:
    16 * (instr('0123456789ABCDEF', substr(hex(encode(f)), 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode(f)), 2 * i, 1)) - 1) as b
  from (select distinct f from features)
), hashed as (
  select f, xor(list_reduce(b, lambda r, x: xor(r >> 8, t[(xor(r, x) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket from bytes, crc_table
), counts as (
  select bucket, count(*) filter (where own) as s, count(*) filter (where not own) as t from features join hashed using (f) group by bucket
), sums as (select sum(s) as big_s, sum(t) as big_t from counts),
gains as (
  select bucket, floor(1000 * ln(cast((t + 1) * (big_s + 10000) as double) / cast((s + 1) * (big_t + 10000) as double))) as gain from counts, sums
), weights as (
  select place, count(*) as n, sum(gain) as total from features join hashed using (f) join gains using (bucket) where own group by place
), scored as (
  select doc_id, len(w) as n_words, cast(coalesce(n, 0) as bigint) as n_features, cast(coalesce(floor(total / n), 0) as bigint) as weight,
    cast(coalesce(floor(total / n), 0) as bigint) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from words left join weights using (place) where own
), placed as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r, count(*) over (partition by n_words >= 20) as fit from scored
)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 10 * fit // 100 then r end as rank from placed""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_cover_tree_negatives", """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same,
         cast(coalesce(list_sum(list_transform(list_zip(a.w, c.w, true), lambda z: z[1] * z[2])), 0) as bigint) as score
  from v a join v c on c.vec_id <> a.vec_id
  where a.vec_id % 100 = 0
), positives as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from scored where same) where r <= 5
), ranked as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         cast(row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as integer) as rank
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


@query("op13_block_max_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
