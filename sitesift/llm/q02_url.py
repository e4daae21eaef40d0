"""Query op2: rules and a list of gambling and adult pages, over all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .registry import register
from .urlfilter import canonical_url, host_of, judge_urls, path_of

RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
#: The list holds the canonical URLs of pages whose host has one of these words.
LISTED_HOST = r"(^|[.-])(casino|poker|betting|porn|xxx)([.-]|$)"

SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
c AS (
  SELECT page_id, host, path, list_sort(list_filter(str_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS params FROM p),
u AS (
  SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE
    regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical FROM c),
rules(h, pre, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT u.page_id, u.host, u.path, arg_max(h || pre, len(h || pre)) AS rule, arg_max(verdict, len(h || pre)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM u) u JOIN rules
    ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, pre) GROUP BY ALL),
listed AS (SELECT DISTINCT canonical FROM u WHERE regexp_matches(host, '{LISTED_HOST}'))
SELECT u.page_id, u.host, u.path, fit.rule,
       CASE WHEN fit.verdict IS NOT NULL THEN fit.verdict WHEN u.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
       u.canonical
FROM u LEFT JOIN fit ON fit.page_id IS NOT DISTINCT FROM u.page_id AND fit.host = u.host AND fit.path = u.path
"""


@register("op2_url_filter", SQL)
def op2_url_filter(spark, sf_dir):
    """Rule and verdict of every page's URL."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOST)).select(canonical_url(F.col("url"), host, path).alias("canonical"))
    return judge_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict", "canonical")
