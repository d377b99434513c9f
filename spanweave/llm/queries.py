"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import chat, codes, decontaminate, langid, licenses, mixing, quality, rules, shards, simhash, substring, urls, vector_sql, whitening
from spanweave.llm.common import NO_ID, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables hold no block list; hosts whose MD5 begins with 0 to 3 stand in for one.
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(urls.host_path(F.col("url"))[0].alias("host")).distinct()
    return urls.filter_urls(pages, hosts.where(F.substring(F.md5("host"), 1, 1).isin("0", "1", "2", "3")))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return said.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "p_document", "p_site", "p_good", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shards.measured(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "size", "text_crc32")
    return shards.cut_along(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_simhash_near_dedup, op3_quality_rules, op4_substring_dedup, op5_url_filter,
        op6_mix_sources, op7_chat_format, op8_license_scan, op9_quality_classifier, op10_language_id,
        op11_hilbert_shards, op12_embedding_whitening, op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = vector_sql.SQL | {
    "op4_substring_dedup": r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') as w from documents
), windows as (
  select doc_id, s, array_to_string(w[s:s + 19], ' ') as p
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from words where len(w) >= 20)
), later as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by p order by doc_id, s) as k from windows) where k > 1
), gone as (
  select distinct doc_id, s + i as place from later, range(20) as r(i)
), placed as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from words
), stay as (
  select p.doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n from placed p anti join gone using (doc_id, place) group by 1
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from words left join stay using (doc_id)""",
    "op5_url_filter": r"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path from pages
), rules(verdict, h, p) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), ruled as (
  select page_id, host, path, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as said
  from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id, host, path
)
select page_id, host, path, rule,
  coalesce(said, case when host <> '' and md5(host)[1] in ('0', '1', '2', '3') then 'block' else 'allow' end) as verdict
from ruled""",
}
