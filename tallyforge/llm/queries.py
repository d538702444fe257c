"""The operators over the given tables, with their SQL twins where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import (
    byte_bpe, conversation_repair, decontamination, exact_dedup, fingerprints, language, minhash_dedup, mixing, sharding, suffix_dedup,
    token_counts, url_filter, whitening)

TIKTOKEN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
  from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id is not distinct from max(doc_id) over g as kept, sha256(body) as text_sha256
from d window g as (partition by body)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3))
    model = language.train(docs.where(fold != 1), PIECES)
    held_out = (fold == 1).alias("held_out")
    predicted = language.predict(docs.select("doc_id", "text"), model, carry=[F.col("doc_id"), held_out])
    return predicted.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    shares = [F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(mixing.DOMAINS)]
    return rated.select(F.col("id").alias("doc_id"), "n_tokens", *shares, "rate", "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                         "near_edited", "near_next")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))


OP8_SQL = r"""
with p as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
j as (
  select page_id, host, path, case
    when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
    when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
    when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
    when (host = 'org' or host like '%.org') and path like '/%' then 'org/'
  end as rule from p)
select page_id, host, path, rule,
  case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict
from j
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), TIKTOKEN, PATTERN, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(_table(spark, sf_dir, "documents"), words=4, similarity=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP12_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
i as (
  select coalesce(cast(item_id as varchar), '') as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark),
spots as (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as p from i where len(ws) > 0),
phrases as (select distinct item, least(len(ws), 10) as size, array_to_string(ws[p:p + 9], ' ') as phrase from spots),
sizes as (select distinct size from phrases),
places as (select r, ws, size, unnest(range(1, len(ws) - size + 2)) as p from d, sizes where len(ws) >= size),
met as (
  select r, p, size, item from (select r, p, size, array_to_string(ws[p:p + size - 1], ' ') as phrase from places)
  join phrases using (size, phrase)),
hit as (select r, count(distinct w) as n_hit from (select r, unnest(range(p, p + size)) as w from (select distinct r, p, size from met)) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from met) group by r)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (r) left join named using (r)
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_repair.digests(conversation_repair.damaged(conversations), conversations.select("conv_id"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_language_id, op3_mixing, op4_token_counts, op5_suffix_dedup, op6_fingerprints, op7_sharding,
    op8_url_filter, op9_byte_bpe, op10_minhash_dedup, op11_whitening, op12_decontamination,
    op13_conversation_repair)}
SQL = {"op1_exact_dedup": OP1_SQL, "op8_url_filter": OP8_SQL, "op12_decontamination": OP12_SQL}
