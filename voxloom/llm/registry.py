"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import bpe, katz, language_id, packing, preference_chat, quality_rules, secret_scan, simhash, transport_stream, url_filter
from voxloom.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_chat.answered_otherwise(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Verdict, and host with path; fixed values of the query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Host labels and first hexadecimal digits of the canonical URL's MD5 that put a URL on the list: whole hosts, and single
#: URLs of any host.
LISTED_LABELS, LISTED_DIGITS = ("cheap-pills", "free-bets"), "0"


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed_urls(pages, LISTED_LABELS, LISTED_DIGITS), URL_RULES)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.read(transport_stream.store(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), language_id.bucket("doc_id") == 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_preference_chat, op3_packing, op4_bpe, op5_url_filter, op6_secret_scan, op7_quality_rules, op8_transport_stream, op9_simhash, op10_katz)}


def oracle_sql() -> dict[str, str]:
    return {"op2_preference_chat": OP2_SQL, "op5_url_filter": OP5_SQL, "op7_quality_rules": OP7_SQL}


OP2_SQL = """
WITH t AS (
    SELECT conv_id, CAST(floor(conv_id / 2) AS BIGINT) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS rn
    FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, k, max(rn) AS rn, arg_max(text, rn) AS text FROM t WHERE role = 'assistant' GROUP BY conv_id, k),
s AS (
    SELECT conv_id, rn, role, text, 0 AS side FROM t
    UNION ALL
    SELECT t.conv_id, t.rn, t.role, CASE WHEN l.rn = t.rn THEN coalesce(o.text, '') ELSE t.text END, 1
    FROM t LEFT JOIN l ON l.conv_id = t.conv_id LEFT JOIN l o ON o.k = t.k AND o.conv_id <> t.conv_id),
w AS (
    SELECT *, replace(replace(role, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS r,
        '<|im_start|>' || r || chr(10) || replace(replace(text, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10) AS shown FROM s),
p AS (
    SELECT conv_id, coalesce(min(CASE WHEN x <> y THEN rn END) - 1, max(rn)) AS n
    FROM (SELECT conv_id, rn, max(text) FILTER (side = 0) AS x, max(text) FILTER (side = 1) AS y FROM s GROUP BY conv_id, rn) GROUP BY conv_id),
f AS (
    SELECT w.*, n, CAST(sum(length(shown)) OVER (PARTITION BY conv_id, side, rn > n ORDER BY rn) AS BIGINT) - length(shown) AS start_at
    FROM w JOIN p USING (conv_id))
SELECT conv_id AS pair_id, CAST(max(n) AS BIGINT) AS n_prefix_turns,
    coalesce(string_agg(shown, '' ORDER BY rn) FILTER (side = 0 AND rn <= n), '') AS prompt,
    coalesce(string_agg(shown, '' ORDER BY rn) FILTER (side = 0 AND rn > n), '') AS chosen,
    coalesce(string_agg(shown, '' ORDER BY rn) FILTER (side = 1 AND rn > n), '') AS rejected,
    coalesce(string_agg((start_at + 13 + length(r)) || ':' || (start_at + length(shown) - 1), ',' ORDER BY rn) FILTER (side = 0 AND rn > n AND role = 'assistant'), '') AS chosen_spans,
    coalesce(string_agg((start_at + 13 + length(r)) || ':' || (start_at + length(shown) - 1), ',' ORDER BY rn) FILTER (side = 1 AND rn > n AND role = 'assistant'), '') AS rejected_spans
FROM f GROUP BY conv_id
"""

OP5_SQL = r"""
WITH u AS (
    SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (
    SELECT *, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
            lambda p: p <> '' AND NOT (starts_with(p, 'utm_') OR starts_with(p, 'fbclid=') OR starts_with(p, 'gclid=') OR starts_with(p, 'ref=')))), '&') AS k FROM u),
c AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN k = '' THEN '' ELSE '?' || k END END AS canonical FROM h),
l AS (SELECT DISTINCT canonical FROM c WHERE (list_has_any(string_split(host, '.'), ['cheap-pills', 'free-bets']) OR starts_with(md5(canonical), '0')) AND canonical IS NOT NULL),
f AS (
    SELECT page_id, host, path, canonical, canonical IN (SELECT canonical FROM l) AS member,
        CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
             WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, canonical, CASE WHEN rule IS NULL THEN coalesce(member, false) END AS listed,
    CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'com/de/' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block'
        ELSE CASE WHEN coalesce(member, false) THEN 'block' ELSE 'allow' END END AS verdict
FROM f
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
g2 AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY doc_id),
ln AS (SELECT doc_id, host, text, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
        trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
    FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
lw AS (SELECT * FROM ln WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id),
hs AS (SELECT host, count(DISTINCT text) AS all_docs FROM lw GROUP BY host),
fr AS (SELECT host, norm FROM lw JOIN hs USING (host) GROUP BY host, norm, all_docs HAVING count(DISTINCT text) > 10 AND 100 * count(DISTINCT text) > all_docs),
rm AS (SELECT doc_id, sum(n) AS removed_words FROM lw SEMI JOIN fr USING (host, norm) GROUP BY doc_id),
f AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
    FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * removed_words > 70 * n_words AS kept
FROM f
"""
