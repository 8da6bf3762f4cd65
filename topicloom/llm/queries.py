"""Registered queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm import bpe, exact_dedup, html_extract, media, mixing, quality, simhash, token_count, toxicity, url_filter
from topicloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counts(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("members")[0].alias("source"), "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.features(media.store(table(spark, sf_dir, "documents")))
    mark = F.transform("landmarks", lambda x: F.concat_ws(":", x["t"].cast("string"), F.lower(F.hex(x["code"]))))
    return out.withColumn("feature", F.array_join(mark, " ")).drop("landmarks")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labelled(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_exact_dedup, op4_quality, op5_html_extract, op6_mixing, op7_media, op8_simhash, op9_url_filter, op10_bpe)}
QUERIES["pipeline"] = corpus_pipeline.run

_SQL3 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, (min(struct_pack(a := -n_cp, b := doc_id))).b AS keep_id FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""


def _strength_sql(rel: str, n: str, k: str) -> str:
    lo, hi = url_filter.STRENGTH
    return f"""(SELECT greatest({lo}, least({hi}, CASE WHEN t > 0 AND p * (1 - p) > 0 AND t - q / t - (m - 1) > 0 AND rho > 0 THEN (1 - rho) / rho ELSE {hi} END)) FROM (
      SELECT *, (r - t * p * p - p * (1 - p) * (m - 1)) / nullif(p * (1 - p) * (t - q / t - (m - 1)), 0) AS rho FROM (
        SELECT *, g / t AS p FROM (SELECT CAST(count(*) AS DOUBLE) AS m, CAST(sum({n}) AS DOUBLE) AS t, CAST(sum({k}) AS DOUBLE) AS g,
          CAST(sum({n} * {n}) AS DOUBLE) AS q, sum(CAST({k} AS DOUBLE) * {k} / {n}) AS r FROM {rel} WHERE {n} > 0))))"""


_SQL9 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
known AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
outcomes AS (SELECT p.host, k.good FROM parsed p LEFT JOIN known k ON TRY_CAST(nullif(regexp_extract(p.path, '^.*/([0-9]{{1,18}})(\.[a-z]+)?/?$', 1), '') AS BIGINT) = k.doc_id),
h0 AS (SELECT host, count(good) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS k FROM outcomes GROUP BY host),
hosts AS (SELECT *, CASE WHEN strpos(host, '.') > 0 THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE host END AS domain, list_extract(string_split(host, '.'), -1) AS suffix FROM h0),
domains AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM domains GROUP BY suffix),
ones AS (SELECT (coalesce(sum(sk), 0) + 1) / (coalesce(sum(sn), 0) + 2) AS mean, {_strength_sql("suffixes", "sn", "sk")} AS s1, {_strength_sql("domains", "dn", "dk")} AS s2, {_strength_sql("hosts", "n", "k")} AS s3 FROM suffixes),
up1 AS (SELECT suffix, s2, s3, (sk + s1 * mean) / (sn + s1) AS sm FROM suffixes, ones),
up2 AS (SELECT domain, s3, (dk + s2 * sm) / (dn + s2) AS dm FROM domains JOIN up1 USING (suffix)),
ab AS (SELECT host, k + s3 * dm AS a, n - k + s3 * (1 - dm) AS b FROM hosts JOIN up2 USING (domain)),
rep AS (SELECT host, a / (a + b) - {url_filter.Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM ab),
judged AS (SELECT page_id, host, path, bound, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM parsed JOIN rep USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= {url_filter.THRESHOLD} THEN 'allow' ELSE 'block' END AS verdict FROM judged
"""

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": _SQL3, "op9_url_filter": _SQL9}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
