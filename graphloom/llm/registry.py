"""Queries of this subpackage, one opN_<name> an operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 4096, end_id=1)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), RULES).drop("url")


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ogg import decode_media, encode_media

    return decode_media(encode_media(table(spark, sf_dir, "documents")), with_payload=False)


def op4_compress_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.compress_quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash_dedup import dedup_classes

    return dedup_classes(table(spark, sf_dir, "documents"))


def op7_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.bitplanes import tokens_round_trip

    return tokens_round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pii_crf import scan_pii

    return scan_pii(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with recursive tags as (
  select url, unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\s[^>]*>)', 1)) as tag
  from pages where html is not null and url like '%://%'),
named as (
  select url, replace(case
    when regexp_matches(tag, '(?i)^<link') and list_contains(regexp_split_to_array(lower(regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*["'']?([^"''>]*)', 1)), '\s+'), 'canonical')
      then regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*["'']?\s*([^"''>\s]*)', 1)
    when regexp_matches(tag, '(?i)^<meta') and regexp_matches(tag, '(?is)[\s"''/]http-equiv\s*=\s*["'']?\s*refresh["''\s/>]')
      then regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*["'']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["'']?\s*([^"''>\s]*)', 1)
    end, '&amp;', '&') as link from tags),
links as (
  select url, case when link = '' or link is null then null
    when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
    when starts_with(link, '//') then regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
    when starts_with(link, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    else regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || case when regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) = '' then '/' else regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) end || link
    end as target from named),
pairs as (
  select translate(regexp_extract(trim(url), '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(trim(url), '(?s)^.*?://[^/?#]*([^#]*)', 1) as a,
    translate(regexp_extract(trim(target), '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(trim(target), '(?s)^.*?://[^/?#]*([^#]*)', 1) as b
  from links where target like '%://%'),
both_ways as (select a, b from pairs union select b, a from pairs),
reach(node, other) as (select a, a from both_ways union select r.node, e.b from reach r join both_ways e on e.a = r.other),
urls as (
  select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    case when url like '%://%' then translate(regexp_extract(trim(url), '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(trim(url), '(?s)^.*?://[^/?#]*([^#]*)', 1) end as node
  from pages),
nodes as (
  select distinct other, regexp_extract(other, '(?s)^.*?://([^/?#]*)', 1) as host, regexp_extract(other, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from reach),
rules(said, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
node_rule as (
  select other, arg_max(said, length(h || p)) as said from nodes join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by other),
passed as (
  select r.node from reach r join node_rule n using (other) group by r.node
  having bool_or(n.said = 'block') and not bool_or(n.said = 'allow')),
hosts as (select distinct host, path from urls),
judged as (
  select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(said, length(h || p)) as said
  from hosts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
select u.page_id, u.host, u.path, j.rule, coalesce(j.said, case when p.node is not null then 'block' end, 'allow') as verdict
from urls u left join judged j using (host, path) left join passed p using (node)
"""


OP9_SQL = r"""
with d as (
  select distinct doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w, text from documents),
dp as (select doc_id, text, len(w) - 4 as n_doc, unnest(range(len(w) - 4)) as pos, w from d where len(w) >= 5),
ds as (select doc_id, text, n_doc, pos, array_to_string(w[pos + 1 : pos + 5], ' ') as h from dp),
b as (
  select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w, text from benchmark),
bp as (select item_id, text, len(w) - 4 as n, unnest(range(len(w) - 4)) as pos, w from b where len(w) >= 5),
bs as (select item_id, text, n, array_to_string(w[pos + 1 : pos + 5], ' ') as h, count(*) as c from bp group by all),
a as (select ds.*, v.n from ds join (select distinct h, n from bs) v using (h)),
o as (select x.doc_id, x.text, x.n, x.pos, x.n_doc, y.h, count(*) as d
  from a x join a y on x.doc_id is not distinct from y.doc_id and x.text = y.text and x.n = y.n and y.pos >= x.pos and y.pos < x.pos + x.n group by all),
m as (select o.doc_id, o.text, o.n, o.pos, o.n_doc, bs.item_id, bs.text as item, sum(least(o.d, bs.c)) as m
  from o join bs on o.n = bs.n and o.h = bs.h group by all),
s as (select *, m / (least(n, n_doc - pos) + n - m) as j from m),
r as (select doc_id, item_id, round(j, 6) as similarity, pos, n,
  row_number() over (partition by doc_id, item_id order by round(j, 6) desc, pos, n) as k from s where j >= 0.8 - 1e-12)
select doc_id, item_id, cast(similarity as double) as similarity, cast(pos as bigint) as first_word, cast(n + 4 as bigint) as n_words from r where k = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_url_filter, op3_ogg_media, op4_compress_quality, op5_secret_scan, op6_simhash_dedup, op7_chained_passages, op8_plane_tokens, op9_decontaminate, op10_pii_crf)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op9_decontaminate": OP9_SQL}
