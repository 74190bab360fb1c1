"""The registered queries of the training-data operators, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.llm.collocations import collocations
from rollmill.llm.conversations import damaged, repair_conversations
from rollmill.llm.decontaminate import find_contamination
from rollmill.llm.fingerprints import fingerprint_edits
from rollmill.llm.license_scan import scan_notices
from rollmill.llm.packing import pack_documents
from rollmill.llm.quality import judge_quality
from rollmill.llm.simhash import near_duplicates
from rollmill.llm.substring import remove_repeats
from rollmill.llm.suffix_dedup import remove_held_before
from rollmill.llm.token_counts import count_tokens
from rollmill.llm.toxicity import held_out, score_toxicity, train
from rollmill.llm.url_filter import HostRule, is_junk, judge_urls, with_canonical

#: Fixed values of the contract.
NOTICES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices of the method's own, each found with one edit or more.
MORE_NOTICES = {
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "mozilla public license": "mpl", "all rights reserved": "reserved",
    "dedicated to the public domain": "public-domain", "creative commons attribution": "cc", "redistribution and use in source and binary forms": "bsd",
}
URL_RULES = (
    HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_notices(table(spark, sf_dir, "documents"), NOTICES | MORE_NOTICES)
    exact = F.filter("spans", lambda s: (s["edits"] == 0) & s["phrase"].isin(*NOTICES))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    start = F.transform(exact, lambda s: s["first_word"])
    near = F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["phrase"]))
    return found.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"), joined(exact).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(near), F.lit(0.0)).alias("score"), "spans",
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The list: canonical URLs of pages whose html holds junk. It blocks every page that goes by such a URL.
    listed = with_canonical(pages.where(is_junk(F.col("html"))), "page_id", "url").select("canonical")
    return judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


OP2_SQL = r"""
WITH t AS (SELECT page_id, coalesce(url, '') AS url, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS text FROM pages),
u AS (SELECT page_id, url, 4 * (length(text) - length(translate(text, '#*$%|', ''))) > len(list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '')) AS junk FROM t),
a AS (SELECT page_id, junk, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
b AS (
  SELECT page_id, junk, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM a),
c AS (
  SELECT page_id, junk, host, path,
    CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') ||
      CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref='))) AS kept FROM b)),
listed AS (SELECT DISTINCT canonical FROM c WHERE junk AND canonical IS NOT NULL),
d AS (
  SELECT c.*, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    canonical IS NOT NULL AND canonical IN (SELECT canonical FROM listed) AS listed FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM d
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("good")).alias("kept"), "posterior",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_held_before(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), alive_col="alive")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
sized AS (SELECT lang, w, i, unnest([1, 2, 3]) AS size FROM placed),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM sized WHERE i + size - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
inside AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM cand WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
left_over AS (SELECT c.* FROM cand c LEFT JOIN longer g ON c.lang = g.lang AND c.phrase = g.phrase AND c.size = 2
  WHERE g.longer IS NULL OR 100 * g.longer < 50 * c.a),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM left_over),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op12_collocations": OP12_SQL}
