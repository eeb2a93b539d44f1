"""The queries of the training-data operators, by name; SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .filter_audit import audit_documents
from .fitting import fit_documents
from .hnsw import near_vectors
from .html import extract
from .lines import repeated_lines
from .packing import pack
from .quality import score_documents
from .release import replay
from .sharding import shard_documents
from .simhash import simhash_dedup
from .suffixes import cut_repeats
from .url_filters import filter_urls, host


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.to - s["from"])
    digest = cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
    # Beside the digest the text that stays, so that a reader sees the cut itself; halves of cut characters are shown as such.
    return digest.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.octet_length("kept").cast("long").alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list for the pages' own hosts, by a rule on MD5 sums, since no table holds one: a third of
    the hosts is blocked on some day of 2024 and released later, some domains are blocked for good, and
    some language folders are blocked or allowed."""
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hosts = pages.select(host(F.col("url")).alias("pattern")).where("pattern <> ''").distinct().withColumn("n", number(F.col("pattern")))
    third = hosts.where("n % 3 = 0")
    domains = hosts.select(F.substring_index("pattern", ".", -2).alias("pattern")).distinct().withColumn("n", number(F.col("pattern")))
    folders = pages.select(F.concat(host(F.col("url")), F.regexp_extract("url", "^[a-z]+://[^/]+(/[a-z]+/)", 1)).alias("pattern")).where("pattern like '%/%'").distinct().withColumn("n", number(F.col("pattern")))
    rows = [
        third.select("pattern", F.lit("block").alias("action"), day(F.col("n") % 300).alias("dated")),
        third.select("pattern", F.lit("allow").alias("action"), day(F.col("n") % 300 + 30 + F.col("n") % 40).alias("dated")),
        domains.where("n % 2 = 0").select("pattern", F.lit("block").alias("action"), day(200 + F.col("n") % 100).alias("dated")),
        folders.where("n % 5 < 2").select("pattern", F.when(F.col("n") % 5 == 0, "block").otherwise("allow").alias("action"), day(F.col("n") % 365).alias("dated")),
    ]
    return reduce(DataFrame.unionByName, rows)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int"))
    found = filter_urls(pages.withColumn("fetched_at", fetched), url_list(pages))
    return found.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "pattern", F.col("valid_from").cast("string").alias("valid_from"), "blocked")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op13_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = replay(table(spark, sf_dir, "conversations"))
    return told.select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", F.col("state").cast("long").alias("state"))


_OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 7919) % 365)::INTEGER AS fetched_at,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host,
         string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS parts
  FROM pages),
named AS (
  SELECT kind, pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS n FROM (
    SELECT DISTINCT 'host' AS kind, host AS pattern FROM p
    UNION ALL SELECT DISTINCT 'domain', array_to_string(string_split(host, '.')[-2:], '.') FROM p
    UNION ALL SELECT DISTINCT 'folder', host || regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]+/)', 1) FROM p
      WHERE regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]+/)', 1) <> '')),
entries AS (
  SELECT pattern, 'block' AS action, DATE '2024-01-01' + (n % 300)::INTEGER AS dated FROM named WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT pattern, 'allow', DATE '2024-01-01' + (n % 300 + 30 + n % 40)::INTEGER FROM named WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT pattern, 'block', DATE '2024-01-01' + (200 + n % 100)::INTEGER FROM named WHERE kind = 'domain' AND n % 2 = 0
  UNION ALL SELECT pattern, CASE WHEN n % 5 = 0 THEN 'block' ELSE 'allow' END, DATE '2024-01-01' + (n % 365)::INTEGER FROM named WHERE kind = 'folder' AND n % 5 < 2),
one AS (SELECT pattern, dated, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS valid_to FROM one),
found AS (
  SELECT p.page_id, p.url, p.fetched_at, s.pattern, s.dated, s.action,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(s.pattern) DESC NULLS LAST) AS rank
  FROM p LEFT JOIN spans s ON s.dated <= p.fetched_at AND (s.valid_to IS NULL OR p.fetched_at < s.valid_to)
    AND (p.host = s.pattern OR ends_with(p.host, '.' || s.pattern)
         OR starts_with(p.host || array_to_string(p.parts, '/'), s.pattern) AND s.pattern LIKE '%/'))
SELECT page_id, url, fetched_at::VARCHAR AS fetched_at, pattern, dated::VARCHAR AS valid_from, coalesce(action = 'block', false) AS blocked
FROM found WHERE rank = 1
"""


_OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT w.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM k a JOIN k b ON b.x <> a.x JOIN k c ON c.x NOT IN (a.x, b.x) JOIN k d ON d.x NOT IN (a.x, b.x, c.x) JOIN k e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, bits[step] AS f, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (mask & (before | f) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & f = f AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & f = f AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = f), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & f = f AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & f = f AND mask & before = 0), 0) AS toxic_lost
  FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality, op2_packing, op3_sharding, op4_hnsw, op5_simhash, op6_decontaminate, op7_lines, op8_suffixes, op9_html, op10_url_filters, op11_filter_audit, op12_fitting, op13_release)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the operator and runs it on whole tables."""
    return {"op10_url_filters": _OP10_SQL, "op11_filter_audit": _OP11_SQL}
