"""Catalog: the run report (P9: A6-A10, A13, J5, O3, O4, U7, U8, S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..sources.archive import read_table
from ..sources.results import CATEGORY_TYPES, dimension, results_from_events
from . import sqlparts as S
from .catalog import register

RESULTS_SQL = """
SELECT event_id AS run_ord,
       'https://' || event_type || '.example/u/' || CAST(user_id AS VARCHAR) AS url,
       event_id % 2 = 0 AS use_browser, 5 AS max_items, event_type <> 'error' AS success,
       CASE WHEN event_type <> 'error' THEN CAST(event_id % 4 AS INTEGER) ELSE 0 END AS items_found,
       value AS time_taken,
       CASE WHEN event_type = 'error' AND event_id % 4 >= 2
            THEN 'HTTP error while fetching page for user ' || CAST(user_id AS VARCHAR) || ' after retries were exhausted'
       END AS error
FROM events
"""

CATMAP_SQL = "(VALUES " + ", ".join(
    f"({S.q(c)}, {S.q(t)})" for c, ts in CATEGORY_TYPES.items() for t in ts
) + ") AS cm(category, event_type)"

DIM_SQL = f"""
SELECT category, url FROM (
  SELECT DISTINCT url, regexp_extract(url, '^https://([^.]+)\\.', 1) AS event_type FROM res
) u JOIN {CATMAP_SQL} USING (event_type)
"""


def _inputs(spark, sf_dir):
    res = results_from_events(read_table(spark, sf_dir, "events"))
    return res, dimension(spark, res)


@register(
    "a6_summary",
    f"""WITH res AS ({RESULTS_SQL})
SELECT count(*)::BIGINT AS total_tests, count_if(success)::BIGINT AS successful_tests,
       count_if(NOT success)::BIGINT AS failed_tests, count_if(use_browser)::BIGINT AS browser_mode_tests,
       count_if(NOT use_browser)::BIGINT AS non_browser_mode_tests,
       round(avg(time_taken), 6) AS avg_time_all,
       coalesce(round(avg(CASE WHEN success THEN time_taken END), 6), 0.0) AS avg_time_success,
       round(avg(items_found), 6) AS avg_items_found, sum(items_found)::BIGINT AS total_items_found
FROM res""",
)
def a6_summary(spark, sf_dir):
    """Overall totals, success/fail, per-mode counts, averages."""
    res, _ = _inputs(spark, sf_dir)
    return R.summary(res)


@register(
    "a7_a9_by_category",
    f"""WITH res AS ({RESULTS_SQL}), dim AS ({DIM_SQL})
SELECT category, count(*)::BIGINT AS total, count_if(success)::BIGINT AS successful,
       round(avg(time_taken), 6) AS avg_time, sum(items_found)::BIGINT AS total_items,
       round(count_if(success) / count(*) * 100, 6) AS success_rate
FROM res JOIN dim USING (url) GROUP BY category""",
)
def a7_by_category(spark, sf_dir):
    """J5 + A7 + A9: per-category totals via URL membership (shared URLs count in both)."""
    res, dim = _inputs(spark, sf_dir)
    return R.by_category(res, dim)


@register(
    "a8_mode_comparison",
    f"""WITH res AS ({RESULTS_SQL})
SELECT CASE WHEN use_browser THEN 'browser' ELSE 'non_browser' END AS mode,
       round(count_if(success) / count(*) * 100, 6) AS success_rate,
       round(avg(time_taken), 6) AS avg_time, round(avg(items_found), 6) AS avg_items
FROM res GROUP BY 1""",
)
def a8_mode_comparison(spark, sf_dir):
    """Success rate, average time and items per mode."""
    res, _ = _inputs(spark, sf_dir)
    return R.mode_comparison(res)


@register(
    "o3_fastest",
    f"""WITH res AS ({RESULTS_SQL})
SELECT run_ord, {S.ellipsis('url', 50)} AS url_label,
       CASE WHEN use_browser THEN 'Browser' ELSE 'Non-Browser' END AS mode, time_taken, items_found
FROM res WHERE success ORDER BY time_taken, run_ord LIMIT 10""",
)
def o3_fastest(spark, sf_dir):
    """O3: ten fastest successful tests (a top-k report)."""
    res, _ = _inputs(spark, sf_dir)
    return R.fastest(res, 10)


@register(
    "o4_u8_failures",
    f"""WITH res AS ({RESULTS_SQL})
SELECT run_ord, {S.ellipsis('url', 40)} AS url_label,
       CASE WHEN use_browser THEN 'Browser' ELSE 'Non-Browser' END AS mode,
       coalesce({S.ellipsis('error', 60)}, 'Unknown error') AS error_label
FROM res WHERE NOT success""",
)
def o4_failures(spark, sf_dir):
    """O4 + U8: failure list with truncated labels and default error text."""
    res, _ = _inputs(spark, sf_dir)
    return R.failures(res)


@register(
    "u8_category_labels",
    f"""WITH res AS ({RESULTS_SQL}), dim AS ({DIM_SQL})
SELECT {S.ellipsis('category', 30)} AS category_label,
       round(count_if(success) / count(*) * 100, 6) AS success_rate,
       round(avg(time_taken), 6) AS avg_time, sum(items_found)::BIGINT AS total_items
FROM res JOIN dim USING (url) GROUP BY category""",
)
def u8_category_labels(spark, sf_dir):
    """U8: category table with names cut at 30 characters."""
    res, dim = _inputs(spark, sf_dir)
    return R.category_labels(R.by_category(res, dim))


@register(
    "a13_run_metadata",
    f"""WITH res AS ({RESULTS_SQL}), dim AS ({DIM_SQL})
SELECT (SELECT count(*) FROM dim)::BIGINT AS total_websites, (SELECT count(*) FROM dim)::BIGINT * 2 AS planned_tests,
       count(*)::BIGINT AS total_tests FROM res""",
)
def a13_run_metadata(spark, sf_dir):
    """A13 + S8: URLs listed per category, planned tests (x2 modes), tests run."""
    res, dim = _inputs(spark, sf_dir)
    return R.run_metadata(res, dim)


_TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_T = S.strip(S.text_of(S.rext(S.remove_noise("html"), _TITLE_RE, 1)))


@register(
    "u7_sample_items",
    f"""SELECT page_id, url,
       {S.ellipsis(S.strip(S.visible_text('html')), 150)} AS content_preview,
       CASE WHEN {_T} <> '' THEN substring({_T}, 1, 100) ELSE 'No title' END AS sample_title
FROM pages""",
)
def u7_sample_items(spark, sf_dir):
    """Per page, the sample preview (title[:100] or 'No title', content[:150] + '...')."""
    from ..functions import html as H
    from ..functions.text import py_strip

    p = read_table(spark, sf_dir, "pages")
    it = p.select(
        "page_id", "url",
        py_strip(H.text_of(F.regexp_extract(H.remove_noise("html"), _TITLE_RE, 1))).alias("title"),
        py_strip(H.visible_text("html")).alias("content"),
    )
    return R.sample_item(it).select("page_id", "url", "content_preview", "sample_title")
