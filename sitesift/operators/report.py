"""Run report over a ``results`` table (P9: A6-A10, A13, J5, O3, O4, U7, U8, K5).

``results(run_ord, url, use_browser, max_items, success, items_found,
time_taken, error, ...)`` holds one row per test; ``dimension(category,
url)`` lists the URLs of each category (a URL may sit in several). All
statistics are single aggregates (partial + final); the category join is on
URL, and the dimension is a small table whose size the caller controls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ellipsis

AVG_DIGITS = 6  # averages are rounded so that engines agree on the last bits


def _avg(c):
    return F.round(F.avg(c), AVG_DIGITS)


def summary(results: DataFrame) -> DataFrame:
    """One row of run totals and averages (avg over successes is 0 if none)."""
    s = F.col("success")
    return results.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(s).alias("successful_tests"),
        F.count_if(~s).alias("failed_tests"),
        F.count_if(F.col("use_browser")).alias("browser_mode_tests"),
        F.count_if(~F.col("use_browser")).alias("non_browser_mode_tests"),
        _avg("time_taken").alias("avg_time_all"),
        F.coalesce(F.round(F.avg(F.when(s, F.col("time_taken"))), AVG_DIGITS), F.lit(0.0)).alias("avg_time_success"),
        _avg("items_found").alias("avg_items_found"),
        F.sum("items_found").cast("long").alias("total_items_found"),
    )


def by_category(results: DataFrame, dimension: DataFrame) -> DataFrame:
    """A7 + A9 via J5: a result counts in every category listing its URL;
    categories without results produce no row.

    Results are pre-aggregated per URL (map-side combine) before the join, so
    a URL with a huge share of the tests is one row on the join's shuffle.
    """
    per_url = results.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("success").alias("ok"),
        F.sum("time_taken").alias("t"),
        F.sum("items_found").alias("items"),
    )
    j = per_url.join(dimension, "url", "inner")
    return j.groupBy("category").agg(
        F.sum("n").alias("total"),
        F.sum("ok").alias("successful"),
        F.round(F.sum("t") / F.sum("n"), AVG_DIGITS).alias("avg_time"),
        F.sum("items").cast("long").alias("total_items"),
        F.round(F.sum("ok") / F.sum("n") * 100, AVG_DIGITS).alias("success_rate"),
    )


def mode_comparison(results: DataFrame) -> DataFrame:
    """Success %, average time and items per mode (no row for an empty mode)."""
    return results.groupBy(
        F.when(F.col("use_browser"), F.lit("browser")).otherwise(F.lit("non_browser")).alias("mode")
    ).agg(
        F.round(F.count_if("success") / F.count(F.lit(1)) * 100, AVG_DIGITS).alias("success_rate"),
        _avg("time_taken").alias("avg_time"),
        _avg("items_found").alias("avg_items"),
    )


def mode_label(use_browser) -> F.Column:
    return F.when(F.col(use_browser), F.lit("Browser")).otherwise(F.lit("Non-Browser"))


def fastest(results: DataFrame, k: int = 10) -> DataFrame:
    """O3: the k fastest successes (ties in run order). The limit is the feature."""
    return (
        results.where("success")
        .orderBy("time_taken", "run_ord")
        .limit(k)
        .select(
            "run_ord",
            ellipsis(F.col("url"), 50).alias("url_label"),
            mode_label("use_browser").alias("mode"),
            "time_taken",
            "items_found",
        )
    )


def failures(results: DataFrame) -> DataFrame:
    """O4 + U8: failed tests with truncated URL and error, default error text."""
    return results.where(~F.col("success")).select(
        "run_ord",
        ellipsis(F.col("url"), 40).alias("url_label"),
        mode_label("use_browser").alias("mode"),
        F.coalesce(ellipsis(F.col("error"), 60), F.lit("Unknown error")).alias("error_label"),
    )


def category_labels(cat_stats: DataFrame) -> DataFrame:
    """U8: category names cut at 30 characters for the printed table."""
    return cat_stats.select(ellipsis(F.col("category"), 30).alias("category_label"), "success_rate", "avg_time", "total_items")


def run_metadata(results: DataFrame, dimension: DataFrame) -> DataFrame:
    """Listed URLs (per category, so shared URLs count twice), planned and run tests."""
    n_urls = dimension.agg(F.count(F.lit(1)).alias("n")).scalar()
    return results.agg(F.count(F.lit(1)).alias("total_tests")).select(
        n_urls.alias("total_websites"), (n_urls * 2).alias("planned_tests"), "total_tests"
    )


def sample_item(items: DataFrame) -> DataFrame:
    """Preview of an item: title[:100] or 'No title', content[:150] + '...'."""
    t = F.col("title")
    return items.select(
        "*",
        F.when(t.isNotNull() & (t != ""), F.substring(t, 1, 100)).otherwise(F.lit("No title")).alias("sample_title"),
        ellipsis(F.col("content"), 150).alias("content_preview"),
    )


def report_record(results: DataFrame, dimension: DataFrame, run_date: str) -> DataFrame:
    """K5: one nested record (metadata, summary, per-category map, mode map).

    Each part is a one-row aggregate; they are combined as scalar subqueries.
    """
    meta = run_metadata(results, dimension)
    summ = summary(results)
    cats = by_category(results, dimension).agg(
        F.map_from_entries(
            F.collect_list(F.struct("category", F.struct("total", "successful", "avg_time", "total_items")))
        ).alias("by_category")
    )
    modes = mode_comparison(results).agg(
        F.map_from_entries(F.collect_list(F.struct("mode", F.struct("success_rate", "avg_time", "avg_items")))).alias(
            "mode_comparison"
        )
    )
    return summ.select(
        F.struct(
            F.lit(run_date).alias("test_run_date"),
            meta.select("total_websites").scalar().alias("total_websites"),
            meta.select("planned_tests").scalar().alias("planned_tests"),
            F.col("total_tests"),
        ).alias("metadata"),
        F.struct(*summ.columns, cats.scalar().alias("by_category"), modes.scalar().alias("mode_comparison")).alias(
            "summary_statistics"
        ),
    )
